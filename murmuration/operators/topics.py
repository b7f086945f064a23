"""Topic links: reply and mention edges, candidates, merge support, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..plans.storage import written
from .segment import asof_activity


def burst_starts(msg: DataFrame, bursts: DataFrame) -> DataFrame:
    """Messages with burst and the place of its first message: at_ms, at_ordinal."""
    rows = msg.join(bursts.select("message_id", "burst"), "message_id")
    first = rows.where("pos = burst").select("chat", "burst", F.col("ms").alias("at_ms"), F.col("ordinal").alias("at_ordinal"))
    return rows.join(first, ["chat", "burst"])


def reply_edges(rows: DataFrame, msg: DataFrame) -> DataFrame:
    """(chat, burst, message_id, topic): a visible message of the burst replies to a message of topic before the burst."""
    target = msg.select("chat", F.col("pos").alias("reply_pos"), F.col("topic").alias("to_topic"), F.col("ms").alias("t_ms"), F.col("ordinal").alias("t_ordinal"))
    e = rows.where("not recalled").join(target, ["chat", "reply_pos"]).where(F.struct("t_ms", "t_ordinal") < F.struct("at_ms", "at_ordinal"))
    return e.select("chat", "burst", "message_id", F.col("to_topic").alias("topic"))


def mention_edges(rows: DataFrame, msg: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(chat, burst, message_id, topic): a visible message mentions a sender who wrote in topic before the burst.

    With active (chat, burst, topic), only for these topics: a sender's older topics are then never joined.
    """
    first = msg.where("not recalled").groupBy("chat", F.col("sender").alias("mention"), "topic").agg(F.min(F.struct("ms", "ordinal")).alias("c"))
    asking = rows.where("not recalled and mention <> 'all'").select("chat", "burst", "message_id", "mention", "at_ms", "at_ordinal")
    if active is None:
        e = asking.join(first, ["chat", "mention"])
    else:
        e = asking.join(active.select("chat", "burst", "topic"), ["chat", "burst"]).join(first, ["chat", "mention", "topic"])
    e = e.where(F.col("c") < F.struct(F.col("at_ms").alias("ms"), F.col("at_ordinal").alias("ordinal")))
    return e.select("chat", "burst", "message_id", "topic")


def burst_topic_edges(rows: DataFrame, msg: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """chat, burst, topic, edges: one edge a message and topic, at most 3 a burst and topic."""
    e = reply_edges(rows, msg).union(mention_edges(rows, msg, active)).distinct()
    return e.groupBy("chat", "burst", "topic").agg(F.least(F.count("*"), F.lit(3)).alias("edges"))


def taking(pairs: DataFrame, rows: DataFrame, states: DataFrame) -> DataFrame:
    """Those of (chat, burst, topic, ...) whose topic may take the burst by its state.

    states: chat, topic, state, closed_ms. An active topic (or one that isn't listed) takes any, a closed one takes what lies
    wholly before its closing, as messages that were imported late do; a merged one takes none.
    """
    ends = rows.where("not recalled").groupBy("chat", "burst").agg(F.max("ms").alias("_end"))
    both = pairs.join(ends, ["chat", "burst"]).join(states.select("chat", "topic", F.col("state").alias("_state"), "closed_ms"), ["chat", "topic"], "left")
    return both.where("coalesce(_state, 'active') = 'active' OR _state = 'closed' AND _end < closed_ms").select(pairs.columns)


def topic_candidates(rows: DataFrame, msg: DataFrame, p: Params, states: DataFrame | None = None) -> DataFrame:
    """chat, burst, topic, rank: topics active before a burst, by links and age; the best k where there are too many.

    With states, only topics whose state lets them take the burst.
    """
    timed = rows
    rows = written(rows.select("chat", "burst", "message_id", "pos", "recalled", "reply_pos", "mention", "at_ms", "at_ordinal"), "rows")  # read four times
    starts = rows.where("pos = burst").select("chat", "burst", "at_ms", "at_ordinal")
    active = asof_activity(starts, msg, p.topic_ttl_ms).join(starts, ["chat", "at_ms", "at_ordinal"])
    active = written(active if states is None else taking(active, timed, states), "active")
    scored = active.join(burst_topic_edges(rows, msg, active), ["chat", "burst", "topic"], "left")
    age = (F.col("at_ms") - F.col("ms")) / float(p.topic_ttl_ms)
    scored = scored.withColumn("score", F.round(p.beta * F.coalesce("edges", F.lit(0)) / 3.0 - p.gamma * age, 9))
    of = Window.partitionBy("chat", "burst")
    ranked = scored.withColumns({"rank": F.row_number().over(of.orderBy(F.desc("score"), F.desc("ms"), "topic")), "n": F.count("*").over(of)})
    return ranked.where((F.col("n") <= p.all_candidates_max) | (F.col("rank") <= p.candidate_k)).select("chat", "burst", "topic", "rank", "score")


def rule_reply(rows: DataFrame, msg: DataFrame, p: Params | None = None, states: DataFrame | None = None) -> DataFrame:
    """chat, burst, topic: all replies that leave the burst resolve to earlier messages of one topic.

    With p and states, only where that topic takes the burst: active within the ttl before it, and by its state.
    """
    target = msg.select("chat", F.col("pos").alias("reply_pos"), F.col("topic").alias("to_topic"), F.lit(True).alias("known"))
    out = rows.where("not recalled and reply_pos is not null and reply_pos < burst").join(target, ["chat", "reply_pos"], "left")
    each = out.groupBy("chat", "burst").agg(F.count_if(F.col("known").isNull()).alias("lost"), F.countDistinct("to_topic").alias("topics"), F.min("to_topic").alias("topic"))
    found = each.where("lost = 0 and topics = 1").select("chat", "burst", "topic")
    if p is None or states is None:
        return found
    starts = rows.where("pos = burst").select("chat", "burst", "at_ms", "at_ordinal")
    active = asof_activity(starts, msg, p.topic_ttl_ms).join(starts, ["chat", "at_ms", "at_ordinal"]).select("chat", "burst", "topic")
    return taking(found.join(active, ["chat", "burst", "topic"], "left_semi"), rows, states)


def merge_pairs(msg: DataFrame, *more: str) -> DataFrame:
    """(chat, a, b, message_id): a visible message replies to an earlier visible one of another topic; a < b; with more columns of the reply."""
    target = msg.where("not recalled").select("chat", F.col("pos").alias("reply_pos"), F.col("topic").alias("to_topic"))
    e = msg.where("not recalled and reply_pos < pos").join(target, ["chat", "reply_pos"]).where("topic <> to_topic")
    return e.select("chat", F.least("topic", "to_topic").alias("a"), F.greatest("topic", "to_topic").alias("b"), "message_id", *more)


def merge_candidates(msg: DataFrame, least: int = 2, since_ms: int | None = None) -> DataFrame:
    """chat, a, b, support, and up to three of the replies, for pairs with enough support.

    With since_ms, only pairs with a reply from then on, and such replies are shown first.
    """
    e = merge_pairs(msg, "ms").withColumn("old", F.lit(False) if since_ms is None else F.col("ms") < since_ms)
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("chat", "a", "b").orderBy("old", "message_id")))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "message_id")))), lambda x: x["message_id"])
    each = e.groupBy("chat", "a", "b").agg(F.count("*").alias("support"), F.array_join(shown, ",").alias("shown"), F.bool_or(~F.col("old")).alias("in_scope"))
    return each.where((F.col("support") >= least) & F.col("in_scope")).drop("in_scope")


def merge_supports(msg: DataFrame, since_ms: int | None = None) -> DataFrame:
    """chat, a, b, support of every pair of settled topics with a reply between them; in_scope: one of the replies is since_ms or later."""
    settled = settled_topics(msg)
    e = merge_pairs(msg, "ms").groupBy("chat", "a", "b").agg(F.count("*").alias("support"), *([] if since_ms is None else [F.bool_or(F.col("ms") >= since_ms).alias("in_scope")]))
    for side in "ab":
        e = e.join(settled.withColumnRenamed("topic", side), ["chat", side], "left_semi")
    return e


def settled_topics(msg: DataFrame) -> DataFrame:
    """Topics with no unfinished message."""
    return msg.select("chat", "topic").distinct().join(msg.where("state in ('pending', 'failed')").select("chat", "topic").distinct(), ["chat", "topic"], "left_anti")


def topic_extent(msg: DataFrame) -> DataFrame:
    return msg.groupBy("chat", "topic").agg(F.count("*").alias("messages"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def context_rows(msg: DataFrame, keep: int = 5) -> DataFrame:
    """The newest visible, finished messages of each topic, with short references in order."""
    newest = F.row_number().over(Window.partitionBy("chat", "topic").orderBy(F.desc("ms"), F.desc("ordinal")))
    rows = msg.where("not recalled and state <> 'pending'").withColumn("newest", newest).where(F.col("newest") <= keep)
    ref = F.concat(F.lit("c"), F.row_number().over(Window.partitionBy("chat", "topic").orderBy("ms", "ordinal")))
    return rows.select("chat", "topic", "message_id", ref.alias("ref"))


def shown_supports(msg: DataFrame, shown: int = 3, least: int = 2) -> DataFrame:
    """chat, a, b, edges, holds: whether the replies shown for a pair still are enough between live messages of both topics."""
    e = merge_pairs(msg).withColumn("k", F.row_number().over(Window.partitionBy("chat", "a", "b").orderBy("message_id"))).where(F.col("k") <= shown)
    return e.groupBy("chat", "a", "b").agg(F.count("*").alias("edges"), (F.count("*") >= least).alias("holds"))


def merged_extent(msg: DataFrame, aliases: DataFrame) -> DataFrame:
    """chat, topic, messages, last_ms, parts of topics after merges; aliases: chat, topic, root."""
    moved = aliases.where("topic <> root").select("chat", "topic", "root")
    both = msg.join(moved, ["chat", "topic"], "left").withColumn("to", F.coalesce("root", "topic"))
    return both.groupBy("chat", F.col("to").alias("topic")).agg(F.count("*").alias("messages"), F.max("ms").alias("last_ms"), F.countDistinct(F.col("topic")).alias("parts"))


def context_with_sources(msg: DataFrame, sources: DataFrame, keep: int = 5) -> DataFrame:
    """context_rows, and with them the visible messages that evidence of the topic's insights comes from, unless they are there already.

    sources: chat, topic, message_id. References of sources are s1, s2, ... in order of time.
    """
    newest = context_rows(msg, keep)
    wanted = sources.select("chat", "topic", "message_id").distinct().join(newest, ["chat", "topic", "message_id"], "left_anti")
    rows = wanted.join(msg.where("not recalled").select("chat", "message_id", "ms", "ordinal"), ["chat", "message_id"])
    ref = F.concat(F.lit("s"), F.row_number().over(Window.partitionBy("chat", "topic").orderBy("ms", "ordinal")))
    return newest.unionByName(rows.select("chat", "topic", "message_id", ref.alias("ref")))
