"""Questions, their answers, and which messages were analysed for relations.

Relations have rel_id, kind, source_id, quote, target_id, source_ms, target_ms, completeness, valid. Bounds are half open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUESTION = ["source_id", "quote"]


def relations_before(rel: DataFrame, until_ms: int) -> DataFrame:
    """Relations with both ends before the bound; those without a target count by their source."""
    return rel.where((F.col("source_ms") < until_ms) & (F.col("target_id").isNull() | (F.col("target_ms") < until_ms)))


def relations_range(rel: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Relations seen before until_ms whose last end is not before since_ms; an earlier source may stay."""
    return relations_before(rel, until_ms).where(F.coalesce("target_ms", "source_ms") >= since_ms)


def question_status(rel: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Valid questions asked since since_ms: answered by a full valid answer, partially_answered by others, or pending."""
    seen = relations_before(rel, until_ms).where("valid")
    answers = seen.where("kind = 'answers'").groupBy(*QUESTION).agg(F.count("*").alias("answers"), F.bool_or(F.coalesce(F.col("completeness") == "full", F.lit(False))).alias("full"))
    status = F.when(F.col("full"), "answered").when(F.col("answers") > 0, "partially_answered").otherwise("pending")
    asked = seen.where((F.col("kind") == "question") & (F.col("source_ms") >= since_ms)).select("rel_id", *QUESTION)
    return asked.join(answers, QUESTION, "left").select("rel_id", *QUESTION, status.alias("status"), F.coalesce("answers", F.lit(0)).alias("answers"))


def open_questions(rel: DataFrame) -> DataFrame:
    """Valid questions of each topic without a valid full answer in that topic, whatever their time."""
    full = rel.where("valid AND kind = 'answers' AND completeness = 'full'").select("topic", *QUESTION)
    return rel.where("valid AND kind = 'question'").join(full, ["topic", *QUESTION], "left_anti").select("topic", "rel_id", *QUESTION)


def relation_coverage(msg: DataFrame, analysed: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Per chat: live messages of a range, how many were analysed, how many were not."""
    done = analysed.select("message_id").distinct().withColumn("done", F.lit(1))
    live = msg.where((F.col("ms") >= since_ms) & (F.col("ms") < until_ms) & ~F.col("recalled")).select("chat", "message_id")
    counted = live.join(done, "message_id", "left").groupBy("chat").agg(F.count("*").alias("messages"), F.count("done").alias("analysed"))
    return counted.withColumn("uncovered", F.col("messages") - F.col("analysed"))
