"""Requests to models as rows: what to extract from, which topic to continue, which topics to merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAITING = ("pending", "failed")


def json_of(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def extraction_rows(msg: DataFrame, items: DataFrame, evidence: DataFrame, keep: int = 5) -> DataFrame:
    """chat, topic, part (new, context, open_item), ref, body: the request of every topic with waiting messages, a row per entry.

    New are its waiting messages, in order. Context are the newest others that were analysed, newest first, then what
    its open items cite. A request is as long as a topic's backlog, so it is never gathered into one value.

    items: insight_id, chat, topic, kind of open items; evidence: insight_id, message_id.
    """
    in_topic = Window.partitionBy("chat", "topic")
    seen = msg.where("NOT recalled").select("chat", "topic", "message_id", "ms", "ordinal", "sender", "text", F.col("state").isin(*WAITING).alias("new"))
    new = seen.where("new").withColumn("k", F.row_number().over(in_topic.orderBy("ms", "ordinal")))
    asked = new.select("chat", "topic").distinct()
    old = seen.where("NOT new").join(asked, ["chat", "topic"], "left_semi")
    newest = old.withColumn("k", F.row_number().over(in_topic.orderBy(F.desc("ms"), F.desc("ordinal")))).where(F.col("k") <= keep)
    cited = items.select("insight_id", F.col("chat").alias("_c"), F.col("topic").alias("_t")).join(evidence.select("insight_id", "message_id"), "insight_id")
    cited = cited.select("message_id", "_c", "_t").distinct()
    # What an item cites may lie in another topic; it is context unless it is a new message of this one.
    cited = seen.join(cited, "message_id").where("chat = _c AND NOT (new AND topic = _t)").withColumn("topic", F.col("_t"))
    cited = cited.join(asked, ["chat", "topic"], "left_semi").join(newest.select("chat", "topic", "message_id"), ["chat", "topic", "message_id"], "left_anti")
    cited = cited.withColumn("k", F.lit(keep) + F.row_number().over(in_topic.orderBy("ms", "ordinal")))
    columns = ["chat", "topic", "k", "message_id", "ms", "sender", "text"]
    context = newest.select(columns).union(cited.select(columns))
    context = context.withColumn("k", F.row_number().over(in_topic.orderBy("k")))
    rows = new.select(F.lit("new").alias("part"), F.lit("n").alias("sign"), *columns).union(context.select(F.lit("context"), F.lit("c"), *columns))
    rows = rows.withColumn("ref", F.concat("sign", F.col("k").cast("string")))
    rows = rows.select("chat", "topic", "part", "ref", json_of(F.struct("ref", "sender", F.col("ms").alias("sent_at"), "text")).alias("body"))
    prior = items.join(asked, ["chat", "topic"], "left_semi")
    prior = prior.withColumn("ref", F.concat(F.lit("e"), F.row_number().over(in_topic.orderBy("insight_id")).cast("string")))
    return rows.union(prior.select("chat", "topic", F.lit("open_item"), "ref", json_of(F.struct("ref", "kind", F.col("insight_id").alias("title")))))


def choice_rows(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """chat, burst, request: which of a burst's ranked candidates do its visible messages continue?

    candidates: chat, burst, topic, rank (all_candidates_max a burst at most); rows: messages with burst (burst_max at most).
    """
    options = candidates.groupBy("chat", "burst").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("c"))
    options = options.withColumn("candidate_topics", F.transform("c", lambda c: F.struct(F.concat(F.lit("T"), (c["rank"] - 1).cast("string")).alias("ref"), c["topic"].alias("title"))))
    said = rows.where("NOT recalled").groupBy("chat", "burst").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("m"))
    both = options.join(said, ["chat", "burst"])
    return both.select("chat", "burst", json_of(F.struct("candidate_topics", F.col("m.text").alias("new_messages"))).alias("request"))


def merge_rows(msg: DataFrame, least: int = 2, shown: int = 3) -> DataFrame:
    """chat, a, b, request: are topics a (T0) and b (T1) one? With up to `shown` replies between them and what they reply to."""
    pair = ["chat", "a", "b"]
    seen = msg.where("NOT recalled")
    target = seen.select("chat", F.col("pos").alias("reply_pos"), F.col("topic").alias("to_topic"))
    e = seen.where("reply_pos < pos").join(target, ["chat", "reply_pos"]).where("topic <> to_topic")
    e = e.select("chat", F.least("topic", "to_topic").alias("a"), F.greatest("topic", "to_topic").alias("b"), "message_id", "pos", "reply_pos")
    of = Window.partitionBy(*pair)
    e = e.withColumns({"k": F.row_number().over(of.orderBy("message_id")), "n": F.count("*").over(of)}).where((F.col("n") >= least) & (F.col("k") <= shown))
    cited = e.select(*pair, F.explode(F.array("pos", "reply_pos")).alias("pos")).distinct()
    cited = cited.join(seen.select("chat", "pos", "topic", "reply_pos", "text"), ["chat", "pos"])
    cited = cited.withColumn("ref", F.concat(F.lit("n"), F.row_number().over(of.orderBy("pos")).cast("string")))
    answers = cited.select(*pair, F.col("pos").alias("reply_pos"), F.col("ref").alias("reply_to_ref"))
    cited = cited.join(answers, [*pair, "reply_pos"], "left")
    entry = F.struct("pos", F.struct("ref", F.when(F.col("topic") == F.col("a"), "T0").otherwise("T1").alias("topic_ref"), "reply_to_ref", "text").alias("entry"))
    each = cited.groupBy(*pair).agg(F.array_sort(F.collect_list(entry)).alias("m"))  # twice `shown` messages at most
    return each.select(*pair, json_of(F.col("m.entry")).alias("request"))


def remapped(cited: DataFrame, refs: DataFrame, *by: str) -> DataFrame:
    """cited (by, topic, ref) with new_ref: its place in its topic's own list, or itself where the topic does not have it.

    refs: by, topic, ref, place of the members of each topic.
    """
    place = Window.partitionBy(*by, "topic").orderBy("place")
    new = refs.select(*by, "topic", "ref", F.concat(F.lit("n"), F.row_number().over(place).cast("string")).alias("_new"))
    return cited.join(new, [*by, "topic", "ref"], "left").withColumn("new_ref", F.coalesce("_new", "ref")).drop("_new")


def answer_log(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """Answers with model (its own, else that of the cached request, else unknown) and aligned (whether their subject is known).

    answers: request_key, subject_kind, subject_id, own_model; cache: request_key, model, one row a request.
    """
    rows = answers.join(cache.select("request_key", F.col("model").alias("_cached")), "request_key", "left")
    aligned = F.coalesce((F.col("subject_kind") != "unknown") & (F.col("subject_id") != ""), F.lit(False))
    return rows.withColumns({
        "model": F.coalesce("own_model", "_cached", F.lit("unknown")), "aligned": aligned,
        "subject_kind": F.when(aligned, F.col("subject_kind")).otherwise("unknown"), "subject_id": F.when(aligned, F.col("subject_id")).otherwise("unavailable"),
    }).drop("own_model", "_cached")
