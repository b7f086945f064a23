"""Saved listings against what they say of themselves and against the messages; topics merged, and all that hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import broken_rules


def listing_problems(headers: DataFrame, listed: DataFrame, evidence: DataFrame, msg: DataFrame) -> DataFrame:
    """listing, item (null for rules of the whole), rule: what is wrong with saved listings.

    headers: listing, counts (map of priority to number), rejected. listed: listing, place, item, kind, priority, rank, status,
    has_deadline. evidence: listing, item, message_id, quote. msg: message_id. Six rules: counts and rejected as emitted, rank
    order (priority, then rank downwards, then item), an item once, unverified only for summaries without deadline, and
    evidence by status: verified items have some, all in known messages; unverified ones one at least; rejected ones may lack it.
    """
    told = listed.groupBy("listing", "priority").agg(F.count("*").alias("n")).groupBy("listing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "n")))).alias("emitted"))
    gone = listed.groupBy("listing").agg(F.count_if(F.col("status") == "rejected").alias("gone"))
    sorted_ = lambda m: F.array_sort(F.filter(F.map_entries(m), lambda e: e["value"] > 0))
    whole = headers.join(told, "listing", "left").join(gone, "listing", "left")
    none = F.create_map().cast("map<string,bigint>")
    counts = sorted_(F.col("counts").cast("map<string,bigint>")) == sorted_(F.coalesce(F.col("emitted"), none))
    of_whole = broken_rules(whole, {"counts": counts, "rejected count": F.col("rejected") == F.coalesce("gone", F.lit(0))}, "listing").select("listing", F.lit(None).cast("string").alias("item"), "rule")

    by_place = Window.partitionBy("listing").orderBy("place")
    before = F.lag(F.struct("priority", (-F.col("rank")).alias("rank"), "item")).over(by_place)
    here = F.struct("priority", (-F.col("rank")).alias("rank"), "item")
    ordered = listed.withColumn("_fine", F.coalesce(before <= here, F.lit(True)))
    known = msg.select("message_id").distinct().withColumn("_known", F.lit(True))
    referenced = evidence.join(known, "message_id", "left").groupBy("listing", "item").agg(F.count("*").alias("_all"), F.count_if(F.col("_known") & (F.trim("quote") != "")).alias("_found"))
    rows = ordered.join(referenced, ["listing", "item"], "left").fillna(0, ["_all", "_found"])
    times = listed.groupBy("listing", "item").agg(F.count("*").alias("_times"))
    rows = rows.join(times, ["listing", "item"])
    rules = {
        "rank order": F.col("_fine"),
        "item is repeated": F.col("_times") == 1,
        "unverified": (F.col("status") != "unverified") | ((F.col("kind") == "topic_summary") & ~F.col("has_deadline")),
        "evidence": (F.col("status") == "rejected") | ((F.col("_found") > 0) & ((F.col("status") != "verified") | (F.col("_found") == F.col("_all")))),
    }
    return of_whole.unionByName(broken_rules(rows, rules, "listing", "item").withColumn("item", F.col("item").cast("string")))


def listing_differences(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by, side (a or b), item, times: items that one of two listings has more often than the other; multiset differences both ways."""
    only = lambda x, y, side: x.select(*by, "item").exceptAll(y.select(*by, "item")).groupBy(*by, "item").agg(F.count("*").alias("times")).withColumn("side", F.lit(side))
    return only(a, b, "a").unionByName(only(b, a, "b")).select(*by, "side", "item", "times")


def snapshot_rows(listed: DataFrame, retained: Column, filtered: bool, usage: DataFrame, *by: str) -> DataFrame:
    """by, metric, numerator, denominator, value, status: rejected rates before and after a filter, counts, tokens, calls and cost.

    filtered: whether the system drops rejected items before it is scored. usage: by, calls, cache_hits, input_tokens,
    output_tokens, cost. Without usage rows its metrics are unavailable; a sum beyond a long is an error, as sums are checked.
    """
    some = listed.withColumn("_kept", F.coalesce(retained, F.lit(False)))
    total = some.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("_kept").alias("kept"), F.count_if(F.col("status") == "rejected").alias("bad"), F.count_if(F.col("_kept") & (F.col("status") == "rejected")).alias("left"))
    spent = usage.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("calls", "cache_hits", "input_tokens", "output_tokens", "cost")])
    rows = total.join(spent, list(by), "left")
    rejected = F.col("total") - F.col("kept") if filtered else F.col("bad")
    metric = lambda name, n, d, v, missing="undefined": F.struct(F.lit(name).alias("metric"), n.cast("double").alias("numerator"), d.cast("double").alias("denominator"), v.cast("double").alias("value"), F.when(v.isNull(), missing).otherwise("ok").alias("status"))
    ratio = lambda name, n, d: metric(name, n, d, F.round(F.try_divide(n, d), 6))
    count = lambda name, n, missing="undefined": metric(name, F.lit(None), F.lit(None), n, missing)
    out = [
        ratio("rejected_rate", rejected, F.col("total")), ratio("rejected_rate_after_filter", F.lit(0) if filtered else F.col("left"), F.col("kept")),
        count("items", F.col("total")), count("scored_items", F.col("kept")),
        *[count(c, F.round(F.col(c), 6), "unavailable_usage") for c in ("calls", "cache_hits", "input_tokens", "output_tokens", "cost")],
    ]
    return rows.select(*by, F.explode(F.array(*out)).alias("m")).select(*by, "m.*")


def merge_cascade(aliases: DataFrame, topics: DataFrame, members: DataFrame, insights: DataFrame, relations: DataFrame, rejected: DataFrame) -> dict[str, DataFrame]:
    """topics, members, insights, relations, rejected after merges: everything follows its topic's root.

    aliases: chat, topic, root (roots of all merges, as merge_closure and alias_root give them). topics: chat, topic, state,
    last_ms; a merged one stays with state merged and merged_into, its root takes the last activity of all. members: chat,
    message_id, topic. insights and relations keep their ids and all but their topic. rejected: chat, a, b; pairs follow, those
    of a topic with itself go, equal ones become one.
    """
    to = aliases.where("topic <> root").select("chat", "topic", F.col("root").alias("_root"))

    def follow(rows: DataFrame, column: str = "topic") -> DataFrame:
        moved = rows.join(to.withColumnRenamed("topic", column), ["chat", column], "left")
        return moved.withColumn(column, F.coalesce("_root", column)).select(rows.columns)

    kept = topics.join(to, ["chat", "topic"], "left").withColumn("_to", F.coalesce("_root", "topic"))
    last = kept.groupBy("chat", "_to").agg(F.max("last_ms").alias("_last"))
    kept = kept.join(last, ["chat", "_to"]).select("chat", "topic", F.when(F.col("_root").isNotNull(), "merged").otherwise(F.col("state")).alias("state"), F.col("_root").alias("merged_into"), F.when(F.col("_root").isNull(), F.col("_last")).otherwise(F.col("last_ms")).alias("last_ms"))
    pairs = follow(follow(rejected, "a"), "b").where("a <> b").select("chat", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return {"topics": kept, "members": follow(members), "insights": follow(insights), "relations": follow(relations), "rejected": pairs}
