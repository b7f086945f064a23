"""Priorities, rank scores, inbox, feedback and deadlines of insights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probability(p: Column) -> Column:
    """p, or null if it is no probability."""
    return F.when((p >= 0) & (p <= 1) & ~F.isnan(p), p)


def priority() -> Column:
    todo = F.when(F.col("assignee").isin("me", "all"), "P0").when(F.col("assignee") == "unknown", "P1").when(F.col("assignee") == "other", "P2")
    kind = F.col("kind")
    return (
        F.when(F.col("bound_date").isNotNull() & (kind != "topic_summary"), "P0")
        .when(kind == "mention_me", F.when(probability(F.col("p_action").cast("double")) >= 0.5, "P0").otherwise("P1"))
        .when(kind == "todo", todo)
        .when(kind.isin("announcement", "decision"), "P1")
        .when(kind == "topic_summary", F.when(probability(F.col("p_chitchat").cast("double")) >= 0.5, "P3").otherwise("P2"))
        .otherwise("unknown")
    )


def rank_prior(now_s: int, confidence: Column, urgency: Column, last_s: Column) -> Column:
    """Deadline nearness + 0.8 confidence + 0.5 urgency / 2 + 0.3 e^(-days since the last evidence), as float.

    A deadline with a time of day counts in days to the second, one without in calendar days; past ones count 0.
    """
    bound_s = F.unix_seconds(F.col("bound_date").cast("timestamp")) + F.col("bound_sec")
    days = F.when(F.col("bound_sec").isNotNull(), (bound_s - now_s) / 86400.0).otherwise(F.datediff("bound_date", F.lit(now_s).cast("timestamp").cast("date")).cast("double"))
    near = F.when(days >= 0, 1.0 / (1.0 + F.greatest(days, F.lit(0.0)))).otherwise(0.0)
    urgent = F.when((urgency >= 0) & (urgency <= 2), urgency / 2.0).otherwise(0.0)
    fresh = F.exp(-F.greatest((F.lit(now_s) - last_s) / 86400.0, F.lit(0.0)))
    return (near + 0.8 * F.coalesce(probability(confidence), F.lit(0.5)) + 0.5 * urgent + 0.3 * fresh).cast("float")


def deadline_open(now_s: int) -> Column:
    """Whether a deadline is not over: to the second with a time of day, else to the day."""
    timed = F.unix_seconds(F.col("bound_date").cast("timestamp")) + F.col("bound_sec") >= now_s
    return F.when(F.col("bound_sec").isNotNull(), timed).otherwise(F.col("bound_date") >= F.lit(now_s).cast("timestamp").cast("date"))


def deadline_open_at(now_s: Column | int, offset_min: Column) -> Column:
    """Whether a deadline is not over by the clock of its anchor: date and time of day are those of the offset (minutes east of UTC).

    With a time of day it holds to that second; without one, while it is still that day or earlier there. Without a date: false.
    """
    now = F.lit(now_s) if isinstance(now_s, int) else now_s
    shift = offset_min.cast("bigint") * 60
    bound = F.unix_date("bound_date") * 86_400 + F.col("bound_sec") - shift
    today = F.floor((now + shift) / 86_400)
    return F.coalesce(F.when(F.col("bound_sec").isNotNull(), bound >= now).otherwise(F.unix_date("bound_date") >= today), F.lit(False))


def deadline_status(now_s: int) -> Column:
    at = F.unix_seconds(F.col("bound_date").cast("timestamp")) + F.col("bound_sec")
    timed = F.when(F.col("relation") == "before", at <= now_s).otherwise(at < now_s)
    past = F.when(F.col("bound_sec").isNotNull(), timed).otherwise(F.col("bound_date") < F.lit(now_s).cast("timestamp").cast("date"))
    sure = F.col("by_rule") & F.col("relation").isin("before", "at") & F.col("bound_date").isNotNull()
    return F.when(~sure, "uncertain").when(past, "overdue").otherwise("upcoming")


def inbox_order(score: str = "score") -> list[Column]:
    """Sort keys of an inbox; scores that are not finite come last in their layer (Spark sorts NaN first)."""
    s = F.col(score)
    finite = F.when(F.isnan(s) | (F.abs(s) == float("inf")), F.lit(float("-inf"))).otherwise(s)
    return [F.col("priority").asc(), finite.desc(), F.col("insight_id").asc()]


def inbox_rank(scored: DataFrame) -> DataFrame:
    """Place of each insight in its topic's inbox."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(*inbox_order())))


def status_merge(a: Column, b: Column) -> Column:
    """The worse of two verification statuses."""
    code = lambda s: F.when(s == "verified", 0).when(s == "unverified", 1).otherwise(2)
    return F.element_at(F.array(F.lit("verified"), F.lit("unverified"), F.lit("rejected")), F.greatest(code(a), code(b)) + 1)


def topic_digest(ranked: DataFrame) -> DataFrame:
    """topic_id, priority and place of its first item, number of items, first three items in order."""
    each = ranked.groupBy("topic_id").agg(F.count("*").alias("items"), F.min(F.struct("place", "priority")).alias("f"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "insight_id")))).alias("t"))
    return each.select("topic_id", "items", F.col("f.priority").alias("priority"), F.array_join(F.transform("t", lambda x: x["insight_id"]), ",").alias("first"))


def preference_weights(votes: DataFrame) -> DataFrame:
    """feature, weight after all events in order: a vote makes w = clamp(0.95 w + 0.2 label, -0.5, 0.5), a decay 0.95 w.

    votes: feature, at, tie, label (1, -1, or 0 for a decay). Events of a feature may be a share of the whole table, so
    they are cut into runs by range partitioning. A run of events is one map clamp(a w + b, lo, hi), as such maps
    compose; a feature has one map a partition, and these are chained.
    """
    name = votes.schema["feature"].dataType.simpleString()
    ordered = votes.select("feature", "at", "tie", "label").repartitionByRange("feature", "at", "tie", "label").sortWithinPartitions("feature", "at", "tie", "label")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, feature, any_ = TaskContext.get().partitionId(), None, False
        a, b, lo, hi, n = 1.0, 0.0, -math.inf, math.inf, 0
        made = []
        for pdf in batches:
            for f, label in zip(pdf["feature"], pdf["label"]):
                if not any_ or f != feature:
                    if any_:
                        made.append((feature, part, a, b, lo, hi, n))
                    feature, any_, a, b, lo, hi, n = f, True, 1.0, 0.0, -math.inf, math.inf, 0
                move = 0.2 * label
                a, b, lo, hi, n = a * 0.95, b * 0.95 + move, lo * 0.95 + move, hi * 0.95 + move, n + 1
                if label:
                    lo, hi = max(-0.5, min(0.5, lo)), max(-0.5, min(0.5, hi))
            yield pd.DataFrame(made, columns=["feature", "part", "a", "b", "lo", "hi", "n"])
            made = []
        if any_:
            yield pd.DataFrame([(feature, part, a, b, lo, hi, n)], columns=["feature", "part", "a", "b", "lo", "hi", "n"])

    maps = ordered.select("feature", "label").mapInPandas(fold, f"feature {name}, part int, a double, b double, lo double, hi double, n bigint")
    each = maps.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "lo", "hi"))).alias("m"), F.sum("n").alias("events"))
    step = lambda w, m: F.greatest(m["lo"], F.least(m["hi"], m["a"] * w + m["b"]))
    return each.select("feature", F.round(F.aggregate("m", F.lit(0.0), step), 9).alias("weight"), "events")


def personal_score(features: DataFrame, weights: DataFrame) -> DataFrame:
    """insight_id, score: prior plus the mean of the weights of its features, unknown ones 0, held to half."""
    w = F.when(F.col("weight").isNull() | F.isnan("weight"), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("weight"))))
    both = features.join(weights, "feature", "left").groupBy("insight_id").agg(F.first("prior").alias("prior"), F.avg(w).alias("m"))
    return both.select("insight_id", F.round(F.col("prior") + F.col("m"), 9).alias("score"))
