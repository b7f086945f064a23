"""Bursts, sessions, cursors and reply interleave of the ordered messages of a chat.

Message tables have chat, ms, ordinal, pos (place in the chat from 1), sender, recalled, reply_pos (place of the
message replied to), state and topic. What runs through a chat goes by spans or chunks of places, or of time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params


#: Windows that run through a whole chat are cut into spans of this many places.
SPAN = 1_000
#: The same for windows over time.
SPAN_MS = 600_000


def running_sums(rows: DataFrame, by: list[str], at: str, order: list[str], values: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Add the values summed over the rows of the same by, up to and with the row itself, in order.

    at is a number that never falls in that order. Sums run within spans of it, plus the totals of the spans before, so
    that no task sorts a whole group.
    """
    rows = rows.withColumns({**values, "_span": F.floor(F.col(at) / span)})
    totals = rows.groupBy(*by, "_span").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_span", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values])
    within = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({v: F.sum(v).over(within) for v in values}).join(before, [*by, "_span"])
    return rows.withColumns({v: F.col(v) + F.col(f"_b_{v}") for v in values}).drop("_span", *[f"_b_{v}" for v in values])


def strong_sessions(msg: DataFrame, gap_ms: int, may: Column | None = None) -> DataFrame:
    """Add session: its number in the chat; a gap of gap_ms or more starts one, where the message may (by default, any)."""
    rows = msg.withColumn("_span", F.floor(F.col("pos") / SPAN))
    ends = rows.groupBy("chat", "_span").agg(F.max("ms").alias("_end"))
    ends = ends.select("chat", "_span", F.lag("_end").over(Window.partitionBy("chat").orderBy("_span")).alias("_end"))
    before = F.coalesce(F.lag("ms").over(Window.partitionBy("chat", "_span").orderBy("pos")), F.col("_end"))
    rows = rows.join(ends, ["chat", "_span"]).withColumn("_open", F.when(before.isNotNull() & ((F.col("ms") - before < gap_ms) | ~(F.lit(True) if may is None else may)), 0).otherwise(1)).drop("_span", "_end")
    return running_sums(rows, ["chat"], "pos", ["pos"], {"session": F.col("_open")}).drop("_open")


def bursts(msg: DataFrame, p: Params, chunk: int = 1_000) -> DataFrame:
    """Add burst (place of its first message in the chat).

    A message joins the burst before it if that has room, the gap is under the strong gap and either under the weak gap,
    or the message replies into the burst, or it has the same sender within the same-sender gap.

    A chat is cut into chunks of places. All that a chunk needs of those before it is the size of the burst at its start,
    burst_max at most, and the messages of that burst. So each chunk gives a map from that size to the size at its end;
    the maps of a chat are chained, and each chunk is replayed from its size.
    """
    most = p.burst_max
    chunk = max(chunk, most)
    rows = msg.select("chat", "pos", "ms", "sender", "message_id", F.coalesce("reply_pos", F.lit(0)).alias("reply_pos"))
    own = F.floor((F.col("pos") - 1) / chunk)
    last_ones = (F.col("pos") - 1) % chunk >= chunk - most
    rows = rows.withColumn("own", own).withColumn("chunk", F.explode(F.when(last_ones, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    kind = rows.schema["chat"].dataType.simpleString()

    def reader(pdf: pd.DataFrame):
        """Places, number of messages before the chunk, and whether message i joins a burst of messages from at to i - 1."""
        pdf = pdf.sort_values("pos", ignore_index=True)
        pos, ms, sender, reply = (pdf[c].tolist() for c in ("pos", "ms", "sender", "reply_pos"))

        def joins(at: int, i: int) -> bool:
            gap = ms[i] - ms[i - 1]
            return i - at < most and gap < p.strong_gap_ms and (gap < p.weak_gap_ms or pos[at] <= reply[i] < pos[i] or sender[i] == sender[i - 1] and gap <= p.same_sender_ms)

        return pdf, pos, int((pdf["own"] < pdf["chunk"]).sum()), joins

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pos, lead, joins = reader(pdf)
        end = len(pos)
        exits: dict[int, int] = {}  # by start of a burst: size of the last burst of the chunk
        out = []
        for size in range(most + 1):
            at, seen, i = lead - size, [], lead
            if size > lead or lead and not size or end == lead:
                out.append(0)  # cannot be
                continue
            while i < end:
                if i == lead and not size or not (i > lead - size and joins(at, i)):
                    at = i
                    if at in exits:
                        break
                    seen.append(at)
                i += 1
            size_out = exits[at] if i < end else end - at
            exits.update(dict.fromkeys(seen, size_out))
            out.append(size_out)
        return pd.DataFrame({"chat": pdf["chat"][:1], "chunk": pdf["chunk"][:1], "exits": [out]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ignore_index=True)
        size, at = 0, []
        for exits in pdf["exits"]:
            at.append(size)
            size = int(exits[size])
        return pd.DataFrame({"chat": pdf["chat"], "chunk": pdf["chunk"], "entry": at})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pos, lead, joins = reader(pdf)
        at, starts = lead - int(pdf["entry"].iloc[0]), []
        for i in range(lead, len(pos)):
            if i == at or not joins(at, i):
                at = i
            starts.append(pos[at])
        pdf = pdf.iloc[lead:]
        return pd.DataFrame({"chat": pdf["chat"], "message_id": pdf["message_id"], "pos": pdf["pos"], "burst": starts})

    maps = rows.groupBy("chat", "chunk").applyInPandas(sizes, f"chat {kind}, chunk long, exits array<long>")
    entries = maps.groupBy("chat").applyInPandas(chain, f"chat {kind}, chunk long, entry long")
    return rows.join(entries, ["chat", "chunk"]).groupBy("chat", "chunk").applyInPandas(replay, f"chat {kind}, message_id string, pos long, burst long")


def prefix_cursor(msg: DataFrame, stops: list[str]) -> DataFrame:
    """chat, ms, ordinal of the last message before the first whose state is in stops; chats without one are absent."""
    place = F.struct("ms", "ordinal")
    first = msg.where(F.col("state").isin(*stops)).groupBy("chat").agg(F.min(place).alias("stop"))
    good = msg.select("chat", place.alias("c")).join(first, "chat", "left").where("stop IS NULL OR c < stop")
    return good.groupBy("chat").agg(F.max("c").alias("c")).select("chat", "c.ms", "c.ordinal")


def reply_edges_in_window(msg: DataFrame) -> DataFrame:
    """chat, source, target (places) and crossed, for replies to earlier messages, neither recalled.

    crossed: at least three visible messages between the two are by neither of their senders. Running counts per chat
    and per sender give the counts between two places without touching what lies between.
    """
    shown = F.when(F.col("recalled"), 0).otherwise(1)
    rows = running_sums(msg.select("chat", "pos", "sender", "recalled", "reply_pos"), ["chat"], "pos", ["pos"], {"seen": shown})
    rows = running_sums(rows, ["chat", "sender"], "pos", ["pos"], {"own": shown})
    visible = rows.where("not recalled")
    target = visible.select("chat", F.col("pos").alias("target"), F.col("sender").alias("to"), F.col("seen").alias("t_seen"), F.col("own").alias("t_own"))
    edges = visible.where("reply_pos < pos").withColumnRenamed("reply_pos", "target").join(target, ["chat", "target"])
    # How many of a sender's messages lie up to a place that is another's: those of the sender's spans before, and of the span up to it.
    asked = edges.select("chat", F.col("sender").alias("who"), F.col("target").alias("at")).union(edges.select("chat", F.col("to").alias("who"), (F.col("pos") - 1).alias("at"))).distinct()
    known = visible.select("chat", F.col("sender").alias("who"), F.col("pos").alias("at"), F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("ask"))
    both = known.unionByName(asked.withColumns({"n": F.lit(0).cast("bigint"), "ask": F.lit(True)}))
    counts = running_sums(both, ["chat", "who"], "at", ["at", "ask"], {"n": F.col("n")}).where("ask").select("chat", "who", "at", "n")
    a = counts.select("chat", F.col("who").alias("sender"), F.col("at").alias("target"), F.col("n").alias("n_source"))
    b = counts.select("chat", F.col("who").alias("to"), (F.col("at") + 1).alias("pos"), F.col("n").alias("n_target"))
    edges = edges.join(a, ["chat", "sender", "target"]).join(b, ["chat", "to", "pos"])
    between = F.col("seen") - F.col("t_seen") - 1
    by_source = F.col("own") - 1 - F.col("n_source")
    by_target = F.when(F.col("sender") == F.col("to"), 0).otherwise(F.col("n_target") - F.col("t_own"))
    return edges.select("chat", F.col("pos").alias("source"), "target", (between - by_source - by_target >= 3).alias("crossed"))


def interleave(msg: DataFrame) -> DataFrame:
    """chat, edges, crossed, ratio (0 without edges)."""
    e = reply_edges_in_window(msg).groupBy("chat").agg(F.count("*").alias("edges"), F.sum(F.col("crossed").cast("bigint")).alias("crossed"))
    chats = msg.select("chat").distinct().join(e, "chat", "left").fillna(0, ["edges", "crossed"])
    return chats.withColumn("ratio", F.when(F.col("edges") > 0, F.round(F.col("crossed") / F.col("edges"), 6)).otherwise(0.0))


def interleave_suffix(msg: DataFrame) -> DataFrame:
    """chat, target, and the edges and crossed edges whose target is there or later: the counts of every suffix."""
    e = reply_edges_in_window(msg).groupBy("chat", "target").agg(F.count("*").alias("n"), F.sum(F.col("crossed").cast("bigint")).alias("x"))
    e = running_sums(e.withColumn("back", -F.col("target")), ["chat"], "back", ["back"], {"edges": F.col("n"), "crossed": F.col("x")})
    return e.select("chat", "target", "edges", "crossed")


def topic_close(msg: DataFrame, ttl_ms: int) -> DataFrame:
    """chat, topic, closed_ms: the first activity in the chat more than ttl after a topic's then last message; open topics are absent."""
    last = msg.groupBy("chat", "topic").agg(F.max("ms").alias("last_ms"))
    marks = msg.select("chat", F.col("ms").alias("at"), F.lit(None).cast("string").alias("topic")).distinct().union(last.select("chat", F.col("last_ms") + ttl_ms, "topic"))
    marks = marks.withColumns({"span": F.floor(F.col("at") / SPAN_MS), "seen": F.when(F.col("topic").isNull(), F.col("at"))})
    # The next activity is in the same span of time, or the first of the next span that has one.
    spans = marks.groupBy("chat", "span").agg(F.min("seen").alias("first"))
    onward = Window.partitionBy("chat").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("chat", "span", F.last("first", ignorenulls=True).over(onward).alias("beyond"))
    after = Window.partitionBy("chat", "span").orderBy(F.desc("at"), F.col("topic").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    nxt = marks.withColumn("here", F.last("seen", ignorenulls=True).over(after)).where("topic is not null").join(spans, ["chat", "span"])
    return nxt.select("chat", "topic", F.coalesce("here", "beyond").alias("closed_ms")).where("closed_ms is not null")


def asof_activity(starts: DataFrame, msg: DataFrame, ttl_ms: int) -> DataFrame:
    """For each (chat, at_ms, at_ordinal) in starts and topic of the chat: its last visible message strictly before, within ttl.

    Messages are reduced to the span of each topic first: a start asks only for topics whose span, longer by the ttl, it
    falls into, by buckets of the ttl. The asked rows and the messages of a topic are then read once in order.
    """
    bucket = lambda c: F.floor(c / ttl_ms)
    m = msg.where("not recalled").select("chat", "topic", "ms", "ordinal")
    spans = m.groupBy("chat", "topic").agg(F.min("ms").alias("lo"), (F.max("ms") + ttl_ms).alias("hi"))
    spans = spans.withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    asked = starts.select("chat", "at_ms", "at_ordinal").withColumn("b", bucket(F.col("at_ms"))).join(spans, ["chat", "b"]).where("at_ms >= lo AND at_ms <= hi")
    none = F.lit(None).cast("bigint")
    both = m.select("chat", "topic", F.col("ms").alias("t"), F.col("ordinal").alias("o"), F.lit(1).alias("later"), F.struct("ms", "ordinal").alias("c"))
    both = both.union(asked.select("chat", "topic", F.col("at_ms"), F.col("at_ordinal"), F.lit(0), F.when(F.lit(False), F.struct(none.alias("ms"), none.alias("ordinal")))))
    # Spans of the ttl: what is within it of a start is in the start's span or the one before, of which the last is enough. A
    # message at a start's own place is not before it, so the question comes first there.
    both = both.withColumn("b", bucket(F.col("t")))
    ends = both.groupBy("chat", "topic", "b").agg(F.max("c").alias("end")).where("end IS NOT NULL").withColumn("b", F.col("b") + 1)
    upto = Window.partitionBy("chat", "topic", "b").orderBy("t", "o", "later").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("near", F.last("c", ignorenulls=True).over(upto)).where("later = 0").join(ends, ["chat", "topic", "b"], "left").withColumn("last", F.coalesce("near", "end"))
    found = seen.where(F.col("last").isNotNull() & (F.col("t") - F.col("last.ms") <= ttl_ms))
    return found.select("chat", F.col("t").alias("at_ms"), F.col("o").alias("at_ordinal"), "topic", F.col("last.ms").alias("ms"), F.col("last.ordinal").alias("ordinal"))


def route(msg: DataFrame, most: int = 60, ratio: float = 0.2) -> DataFrame:
    """chat, pending, direct: chats whose backlog is small and little interleaved are analysed directly."""
    pending = msg.groupBy("chat").agg(F.count_if((F.col("state") == "pending") & ~F.col("recalled")).alias("pending"))
    return pending.join(interleave(msg), "chat").select("chat", "pending", ((F.col("pending") <= most) & (F.col("ratio") < ratio)).alias("direct"))
