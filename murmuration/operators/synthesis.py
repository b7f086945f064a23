"""Insights that no model proposes: mentions of the reader that nothing covers, and a topic's summary, whole and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import priority
from .verify import verify_rendered

#: The title of a mention, and how many characters of a message stand for it.
MENTION_TITLE = "有人在群聊中提及你"
SUMMARY_CHARS, QUOTE_CHARS, SUMMARY_EVIDENCE = 200, 60, 2
FIELDS = ("insight_id", "chat", "topic", "kind", "title", "summary", "priority", "assignee", "confidence", "lifecycle", "created_in_run", "status")


def stable_id(chat: Column, topic: Column, run: Column, name: Column) -> Column:
    """The same insight made again in a run has the same id."""
    return F.concat(F.lit("i_"), F.substring(F.sha2(F.concat_ws("|", chat.cast("string"), topic, run, name), 256), 1, 16))


def _checked(rows: DataFrame, view: DataFrame) -> DataFrame:
    """Insights with evidence: array<struct<message_id, quote>>, their priority and status by the render view."""
    rows = rows.withColumn("bound_date", F.lit(None).cast("date")).withColumn("priority", priority())
    cited = rows.select("insight_id", F.posexplode("evidence").alias("idx", "e")).select("insight_id", "idx", "e.message_id", "e.quote")
    asked = rows.select("insight_id", "kind", F.lit(None).cast("string").alias("deadline_raw"), F.lit(1).alias("profile"))
    status = verify_rendered(asked, cited, view).select("insight_id", "status")
    return rows.join(status, "insight_id").select(*FIELDS, "evidence")


def mention_insights(new: DataFrame, view: DataFrame, covered: DataFrame, run: str) -> DataFrame:
    """An insight of kind mention_me for each new message that mentions the reader and that no verified insight's evidence has.

    new: chat, topic, message_id, mentions_me, p_action (or null). view: message_id, text, recalled (the render view). covered:
    message_id. FIELDS and evidence, the message itself by its first characters.
    """
    rows = new.where("mentions_me").join(covered.select("message_id").distinct(), "message_id", "left_anti").join(view.select("message_id", "text"), "message_id")
    made = rows.select(
        stable_id(F.col("chat"), F.col("topic"), F.lit(run), F.concat(F.lit("mention:"), "message_id")).alias("insight_id"), "chat", "topic", F.lit("mention_me").alias("kind"), F.lit(MENTION_TITLE).alias("title"),
        F.substring("text", 1, SUMMARY_CHARS).alias("summary"), F.lit("me").alias("assignee"), F.lit(1.0).alias("confidence"), F.lit("open").alias("lifecycle"), F.lit(run).alias("created_in_run"), "p_action", F.lit(None).cast("double").alias("p_chitchat"),
        F.array(F.struct("message_id", F.substring("text", 1, QUOTE_CHARS).alias("quote"))).alias("evidence"))
    return _checked(made, view)


def summary_insights(outputs: DataFrame, new: DataFrame, view: DataFrame, previous: DataFrame, run: str) -> DataFrame:
    """An insight of kind topic_summary for each topic whose summary is not blank; one that the topic has already is written again.

    outputs: chat, topic, title, summary, p_chitchat (or null). new: chat, topic, message_id, ms. previous: chat, topic,
    insight_id, created_in_run of summaries that are stored (one a topic). Evidence: the first new messages, by time, then id.
    """
    place = F.row_number().over(Window.partitionBy("chat", "topic").orderBy("ms", "message_id"))
    first = new.withColumn("k", place).where(F.col("k") <= SUMMARY_EVIDENCE).join(view.select("message_id", "text"), "message_id")
    cited = first.groupBy("chat", "topic").agg(F.array_sort(F.collect_list(F.struct("k", "message_id", F.substring("text", 1, QUOTE_CHARS).alias("quote")))).alias("evidence"))
    rows = outputs.where(F.trim("summary") != "").join(cited, ["chat", "topic"], "left").join(previous.select("chat", "topic", F.col("insight_id").alias("old"), F.col("created_in_run").alias("old_run")), ["chat", "topic"], "left")
    none = F.array().cast("array<struct<message_id:string,quote:string>>")
    made = rows.select(
        F.coalesce("old", stable_id(F.col("chat"), F.col("topic"), F.lit(run), F.lit("summary"))).alias("insight_id"), "chat", "topic", F.lit("topic_summary").alias("kind"), "title", "summary", F.lit("unknown").alias("assignee"), F.lit(None).cast("double").alias("confidence"),
        F.lit("open").alias("lifecycle"), F.coalesce("old_run", F.lit(run)).alias("created_in_run"), F.lit(None).cast("double").alias("p_action"), "p_chitchat",
        F.coalesce(F.transform("evidence", lambda e: F.struct(e["message_id"].alias("message_id"), e["quote"].alias("quote"))), none).alias("evidence"))
    return _checked(made, view)


def topic_conflicts(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """insight_id, topic, other: proposals that would move a stored insight to another topic; such an upsert is an error."""
    return stored.select("insight_id", "topic").join(proposed.select("insight_id", F.col("topic").alias("other")), "insight_id").where("NOT topic <=> other").distinct()
