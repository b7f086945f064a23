"""Insights as they are made, kept and shown: evidence, life cycle, views, requests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unread(evidence: DataFrame, msg: DataFrame, reviewed: DataFrame) -> DataFrame:
    """insight_id, unread: whether any evidence lies after what its chat's reader has seen; without a cursor all does. reviewed: chat, ms, ordinal."""
    seen = reviewed.select("chat", F.struct("ms", "ordinal").alias("seen"))
    at = msg.select("message_id", "chat", F.struct("ms", "ordinal").alias("at")).join(seen, "chat", "left")
    new = F.coalesce(F.col("at") > F.col("seen"), F.lit(True))
    return evidence.join(at, "message_id").groupBy("insight_id").agg(F.bool_or(new).alias("unread"))


def seen_before(evidence: DataFrame, msg: DataFrame, until_ms) -> DataFrame:
    """insight_id of insights all of whose evidence is there and before until_ms (a number or a one-row table's column)."""
    rows = evidence.join(msg.select("message_id", "ms"), "message_id", "left")
    return rows.groupBy("insight_id").agg(F.bool_and(F.coalesce(F.col("ms") < until_ms, F.lit(False))).alias("ok")).where("ok").select("insight_id")


def last_action(actions: DataFrame, key: str = "insight_id") -> DataFrame:
    """key, action: the last of each key's actions by (at, tie); doing one again changes nothing."""
    return actions.groupBy(key).agg(F.max_by("action", F.struct("at", "tie")).alias("action"))


def upsert(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """insight_id, title, lifecycle, evidence: stored insights keep their life cycle, and evidence is appended without what is there; others are new.

    stored: insight_id, title, lifecycle, evidence (array). proposed: insight_id, title, evidence.
    """
    both = stored.select("insight_id", F.col("title").alias("t"), "lifecycle", F.col("evidence").alias("e")).join(proposed, "insight_id", "full_outer")
    none = F.array().cast("array<string>")
    return both.select("insight_id", F.coalesce("title", "t").alias("title"), F.coalesce("lifecycle", F.lit("open")).alias("lifecycle"), F.array_union(F.coalesce("e", none), F.coalesce("evidence", none)).alias("evidence"))


def first_evidence(msg: DataFrame, keep: int = 2, chars: int = 60) -> DataFrame:
    """chat, topic, message_id, quote, place: the first live messages of each topic, with their first characters."""
    place = F.row_number().over(Window.partitionBy("chat", "topic").orderBy("ms", "ordinal"))
    rows = msg.where("NOT recalled").withColumn("place", place).where(F.col("place") <= keep)
    return rows.select("chat", "topic", "message_id", F.substring("text", 1, chars).alias("quote"), "place")


def deadline_anchor(evidence: DataFrame, msg: DataFrame, raw: Column, now_ms: int, *keep: str) -> DataFrame:
    """keep, anchor_ms: when the first evidence message that contains raw was sent, else the first evidence message, else now."""
    rows = evidence.join(msg.select("message_id", "ms", "text"), "message_id", "left").withColumn("raw", raw)
    each = rows.groupBy(*keep).agg(F.min_by("ms", F.when(F.col("ms").isNotNull() & F.contains("text", "raw"), F.struct("idx", "message_id"))).alias("said"), F.min_by("ms", F.when(F.col("ms").isNotNull(), F.struct("idx", "message_id"))).alias("first"))
    return each.select(*keep, F.coalesce("said", "first", F.lit(now_ms)).alias("anchor_ms"))


def within_size(ranked: DataFrame, limit: int, *by: str) -> DataFrame:
    """Rows of the ranked list (rank, size) of each by whose sizes sum to limit at most, from the best."""
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("size").over(upto)).where(F.col("used") <= limit)


def not_answered(requests: DataFrame, answers: DataFrame, body: str = "body") -> DataFrame:
    """request_key and copies of the requests that no answer has yet; equal requests are one. answers: request_key."""
    keyed = requests.groupBy(F.sha2(F.col(body), 256).alias("request_key")).agg(F.count("*").alias("copies"))
    return keyed.join(answers.select("request_key").distinct(), "request_key", "left_anti")


def order_breaks(rows: DataFrame, order: list[Column], place: str, *by: str) -> DataFrame:
    """Rows of a list, by its place, that stand before where they belong: the row before has a greater key."""
    key = F.struct(*order)
    return rows.withColumn("_key", key).withColumn("_before", F.lag("_key").over(Window.partitionBy(*by).orderBy(place))).where("_before > _key").drop("_key", "_before")


def best_assignment(cells: list[tuple]) -> dict:
    """Partner of each left in a one-to-one matching of greatest total weight; cells: (left, right, weight > 0), others weigh 0.

    One more pair at a time: of all ways to exchange partners along cells that end at a free right, the one that gains most,
    until none gains. Gains of such ways never rise, so what no single way improves is best. A way is found by passing gains
    along cells until none improves.
    """
    near: dict = {}
    for left, right, weight in cells:
        near.setdefault(left, []).append((right, weight))
    mate: dict = {}  # right -> (left, weight)
    while True:
        gain: dict = {}  # of reaching a right, its own partner set free
        came: dict = {}
        free = set(near) - {left for left, _ in mate.values()}
        queue = [(left, 0) for left in free]
        while queue:
            after = {}
            for left, so_far in queue:
                for right, weight in near[left]:
                    if mate.get(right, (None,))[0] != left and so_far + weight > gain.get(right, 0):
                        gain[right], came[right] = so_far + weight, (left, weight)
                        if right in mate:
                            partner, lost = mate[right]
                            after[partner] = max(after.get(partner, -math.inf), gain[right] - lost)
            queue = list(after.items())
        ends = {r: g for r, g in gain.items() if r not in mate}
        # A way may also end at a left that is given up, where the exchange still gains.
        ends |= {r: g - mate[r][1] for r, g in gain.items() if r in mate and g > mate[r][1]}
        if not ends:
            return {left: right for right, (left, _) in mate.items()}
        right = max(ends, key=lambda r: ends[r])
        held = {left: r for r, (left, _) in mate.items()}
        while right is not None:
            left, weight = came[right]
            right_of_left = held.get(left)
            mate[right] = (left, weight)
            if right_of_left is not None:
                del mate[right_of_left]
            right = right_of_left


def one_to_one(rows: DataFrame, by: str = "chat", most: int = 512) -> DataFrame:
    """by, matched, total, overlap, status: members of predicted threads p that fall to gold threads g in the best one-to-one matching.

    Only counts of (p, g) go to a group, and no group has more than most threads a side: beyond that it is unavailable.
    """
    cells = rows.groupBy(by, "p", "g").agg(F.count("*").alias("n"))
    sides = cells.groupBy(by).agg(F.sum("n").alias("total"), F.greatest(F.countDistinct("p"), F.countDistinct("g")).alias("most"))
    small = cells.join(sides.where(F.col("most") <= most), by)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = {(p, g): int(n) for p, g, n in zip(pdf["p"], pdf["g"], pdf["n"])}
        matched = sum(weight[pair] for pair in best_assignment([(*k, n) for k, n in weight.items()]).items())
        return pd.DataFrame({by: pdf[by][:1], "matched": [matched], "total": pdf["total"][:1]})

    kind = rows.schema[by].dataType.simpleString()
    done = small.groupBy(by).applyInPandas(match, f"{by} {kind}, matched bigint, total bigint")
    done = done.select(by, "matched", "total", F.round(F.col("matched") / F.col("total"), 6).alias("overlap"), F.lit("ok").alias("status"))
    rest = sides.where(F.col("most") > most).select(by, F.lit(None).cast("bigint"), "total", F.lit(None).cast("double"), F.lit("unavailable_too_many_threads"))
    return done.union(rest)


def deadline_fallback(rows: DataFrame, sure: float = 0.9, guess: float = 0.5) -> DataFrame:
    """insight_id, bound_date, by, confidence: a guessed date (text) counts, with less confidence, where the rules gave none and it is a date."""
    guessed = F.col("guess").try_cast("date")
    rule = F.col("bound_date").isNotNull()
    return rows.select("insight_id", F.coalesce("bound_date", guessed).alias("bound_date"), F.when(rule, "rule").when(guessed.isNotNull(), "guess").alias("by"), F.when(rule, sure).when(guessed.isNotNull(), guess).alias("confidence"))
