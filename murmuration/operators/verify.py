"""Evidence checks: is each quoted passage in a live message?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_found, quote_span, squeezed
from ..sources.exports import render


def evidence_failures(evidence: DataFrame, msg: DataFrame) -> DataFrame:
    """Evidence rows with failure: message_not_found, recalled, quote_too_short, quote_not_found, or null."""
    m = msg.select("message_id", "text", "recalled")
    rows = evidence.join(m, "message_id", "left")
    failure = (
        F.when(F.col("text").isNull(), "message_not_found")
        .when(F.col("recalled"), "recalled")
        .when(F.length(squeezed(F.col("quote"))) < 3, "quote_too_short")
        .when(~quote_found(F.col("text"), F.col("quote")), "quote_not_found")
    )
    return rows.withColumn("failure", failure)


def verify_evidence(insights: DataFrame, evidence: DataFrame, msg: DataFrame) -> DataFrame:
    """insight_id, status, ok, bad, failures in order of evidence; without evidence: no_evidence."""
    rows = evidence_failures(evidence, msg).groupBy("insight_id").agg(
        F.count_if(F.col("failure").isNull()).alias("ok"), F.count("failure").alias("bad"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("idx", "failure", "message_id")))), lambda x: x["failure"]), ",").alias("failures"),
    )
    all_ = insights.select("insight_id", "kind", "bound_date").join(rows, "insight_id", "left")
    failures = F.coalesce("failures", F.lit("no_evidence"))
    summary = (F.col("kind") == "topic_summary") & F.col("bound_date").isNull() & (F.col("ok") > 0)
    status = F.when(failures == "", "verified").when(summary, "unverified").otherwise("rejected")
    return all_.select("insight_id", status.alias("status"), F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("bad", F.lit(0)).alias("bad"), failures.alias("failures"))


def evidence_view(evidence: DataFrame, msg: DataFrame) -> DataFrame:
    """Evidence found in live messages, with the characters that the quote covers."""
    rows = evidence_failures(evidence, msg).where("failure is null").withColumn("span", quote_span(F.col("text"), F.col("quote")))
    return rows.select("insight_id", "idx", "message_id", F.col("span.at").cast("bigint").alias("at"), F.col("span.until").cast("bigint").alias("until"))


#: Versions of the render profile that evidence may refer to.
PROFILES = (1,)


def rendered(msg: DataFrame, profile: int = 1) -> DataFrame:
    """message_id, text (what a reader sees of it under the profile), recalled; msg: message_id, text, system, recalled, forward.

    Evidence is quoted from this text: forwards count, recalled messages show nothing.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown render profile {profile}")
    return msg.select("message_id", render(F.col("text"), F.col("system"), F.col("recalled"), F.col("forward")).alias("text"), "recalled")


def verify_rendered(insights: DataFrame, evidence: DataFrame, view: DataFrame) -> DataFrame:
    """insight_id, status, ok, failures: evidence against the render view, and deadlines against evidence that holds.

    insights: insight_id, kind, deadline_raw, profile. evidence: insight_id, idx, message_id, quote. view: message_id, text,
    recalled, as rendered() gives it. Failures, in order: unsupported_profile (alone), no_evidence, those of evidence_failures
    by idx, and deadline_not_in_evidence if no evidence that holds has the deadline's words. Without failures an insight is
    verified; a summary without a deadline that has some evidence is unverified; any other is rejected.
    """
    asked = insights.select("insight_id", "kind", "deadline_raw", F.coalesce(F.col("profile").isin(*PROFILES), F.lit(False)).alias("fits"))
    rows = evidence_failures(evidence, view).join(asked.where("fits").select("insight_id", "deadline_raw"), "insight_id")
    each = rows.groupBy("insight_id").agg(
        F.count_if(F.col("failure").isNull()).alias("ok"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("idx", "failure", "message_id")))), lambda x: x["failure"]).alias("bad"),
        F.coalesce(F.bool_or(F.col("failure").isNull() & quote_found(F.col("text"), F.col("deadline_raw"))), F.lit(False)).alias("supported"),
    )
    both = asked.join(each, "insight_id", "left")
    bad = F.coalesce("bad", F.array(F.lit("no_evidence")))
    unsupported = F.when(F.col("deadline_raw").isNotNull() & ~F.coalesce("supported", F.lit(False)), F.array(F.lit("deadline_not_in_evidence"))).otherwise(F.array().cast("array<string>"))
    failures = F.when(~F.col("fits"), F.array(F.lit("unsupported_profile"))).otherwise(F.concat(bad, unsupported))
    out = both.select("insight_id", "kind", "deadline_raw", F.coalesce("ok", F.lit(0)).alias("ok"), F.array_join(failures, ",").alias("failures"))
    summary = (F.col("kind") == "topic_summary") & F.col("deadline_raw").isNull() & (F.col("ok") > 0)
    return out.select("insight_id", F.when(F.col("failures") == "", "verified").when(summary, "unverified").otherwise("rejected").alias("status"), "ok", "failures")


def rendered_spans(evidence: DataFrame, view: DataFrame) -> DataFrame:
    """insight_id, idx, message_id, at, until: the characters of the render view that a quote covers, where it is found."""
    return evidence_view(evidence, view)
