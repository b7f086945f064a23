"""Imports into stored messages: new rows, copies, later recalls, conflicts of identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chat", "source_identity"]


def merge_import(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Messages after an import: KEY, message_id, text, recalled, state, change (new, recalled, same).

    stored: KEY, message_id, text, recalled, state. incoming: KEY, message_id, text, recalled, place (order of the import).
    The first copy of a message is the one that stays. A recall in any copy is for good: the text goes and the message is
    skipped; a stale copy never brings it back. Rows are combined per message before anything is joined.
    """
    one = incoming.groupBy(*KEY).agg(F.min_by(F.struct("message_id", "text"), "place").alias("first"), F.bool_or("recalled").alias("gone"))
    both = stored.withColumn("known", F.lit(True)).join(one, KEY, "full_outer")
    known = F.coalesce("known", F.lit(False))
    recalled = F.coalesce("recalled", F.lit(False)) | F.coalesce("gone", F.lit(False))
    newly = recalled & ~F.coalesce("recalled", F.lit(False))
    return both.select(
        *KEY, F.coalesce("message_id", "first.message_id").alias("message_id"), F.when(recalled, "").otherwise(F.coalesce("text", "first.text")).alias("text"), recalled.alias("recalled"),
        F.when(newly, "skipped").otherwise(F.coalesce("state", F.lit("pending"))).alias("state"), F.when(~known, "new").when(newly, "recalled").otherwise("same").alias("change"),
    )


def id_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """KEY and both ids where an import has another message id for a known identity."""
    other = incoming.select(*KEY, F.col("message_id").alias("other_id")).distinct()
    return stored.select(*KEY, "message_id").join(other, KEY).where("message_id <> other_id")


def identity_conflicts(chats: DataFrame, told: DataFrame, *fields: str) -> DataFrame:
    """chat, field, stored, told: where an import tells another value of a chat's own identity than the stored one."""
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").alias("stored"), F.col(f"t.{f}").alias("told")) for f in fields])
    each = chats.alias("s").join(told.alias("t"), F.col("s.chat") == F.col("t.chat")).select(F.col("s.chat").alias("chat"), F.explode(names).alias("x")).select("chat", "x.*")
    return each.where("stored <> '' AND told <> '' AND stored <> told").distinct()


def backfilled(incoming: DataFrame, cursors: DataFrame) -> DataFrame:
    """chat, backfilled: imported messages at or before what was already analysed; cursors: chat, ms, ordinal."""
    both = incoming.join(cursors.select("chat", F.struct("ms", "ordinal").alias("c")), "chat", "left")
    return both.groupBy("chat").agg(F.count_if(F.coalesce(F.struct("ms", "ordinal") <= F.col("c"), F.lit(False))).alias("backfilled"))


def mark_read(chats: DataFrame, asked: DataFrame, msg: DataFrame, safe: DataFrame) -> DataFrame:
    """chat, ms, ordinal, moved: each chat's read cursor after requests (chat, ms, ordinal).

    A cursor moves to a request that is a message of the chat, not beyond safe (the last of the finished prefix), and never back.
    """
    at = lambda name: F.struct("ms", "ordinal").alias(name)
    good = asked.join(msg.select("chat", "ms", "ordinal"), ["chat", "ms", "ordinal"], "left_semi").join(safe.select("chat", at("safe")), "chat").where(F.struct("ms", "ordinal") <= F.col("safe"))
    best = good.groupBy("chat").agg(F.max(F.struct("ms", "ordinal")).alias("new"))
    both = chats.select("chat", at("old")).join(best, "chat", "left")
    moved = F.coalesce(F.col("new") > F.col("old"), F.lit(False))
    to = F.when(moved, F.col("new")).otherwise(F.col("old"))
    return both.select("chat", to["ms"].alias("ms"), to["ordinal"].alias("ordinal"), moved.alias("moved"))
