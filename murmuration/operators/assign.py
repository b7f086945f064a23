"""Online assignment: bursts in order, each to the topic that it continues, or to a new one.

A choice rests on all before it, and one that differs changes those after it, so the choices of a chat are made in order, by
one task. All else is done before, in parallel: messages become a row a burst, and each place knows the last burst that
replies to it. A chat's bursts are read as a sorted stream. What the fold keeps is the topics that can still take a burst and
the places that later bursts still ask for, so its memory doesn't grow with the chat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params

CHUNK = 500


class Topic:
    """What a fold knows of a topic: its last message, until when it took bursts, until when it is kept, who wrote, places that are still asked for."""

    __slots__ = ("last", "until", "kept", "senders", "places")

    def __init__(self, until: int | None = None, kept: int = 0):
        self.last, self.until, self.kept, self.senders, self.places = 0, until, kept, set(), set()

    def takes(self, start: int, end: int, ttl: int) -> bool:
        return start - self.last <= ttl and (self.until is None or end < self.until)


class Chat:
    """The state of a chat's fold: topics by the place of their first message, and the topic of each place that is still asked for."""

    def __init__(self):
        self.live: dict[int, Topic] = {}
        self.at: dict[int, int] = {}
        self.ends: dict[int, list[int]] = {}  # by burst: places that no later burst asks for

    def expire(self, start: int, ttl: int) -> None:
        for k in [k for k, t in self.live.items() if start - t.last > ttl and start > t.kept]:
            for x in self.live.pop(k).places:
                del self.at[x]

    def add(self, k: int, pos: int, ms: int, sender: str, asked: int | None) -> None:
        topic = self.live[k]
        topic.last = ms
        topic.senders.add(sender)
        if asked is not None:
            topic.places.add(pos)
            self.at[pos] = k
            self.ends.setdefault(asked, []).append(pos)

    def past(self, burst: int) -> None:
        for x in self.ends.pop(burst, ()):
            if x in self.at:
                self.live[self.at.pop(x)].places.discard(x)


def assign_online(
    msg: DataFrame, bursts: DataFrame, p: Params, least: float = 0.0, assigned: DataFrame | None = None, topics: DataFrame | None = None, answers: DataFrame | None = None, chunk: int = CHUNK
) -> DataFrame:
    """chat, burst, topic (place of the topic's first message), method, for the bursts that have no topic yet.

    msg: chat, pos, ms, sender, recalled, reply_pos, mention; bursts: chat, pos, burst. Recalled messages take no part, nor do
    bursts of nothing else. assigned: chat, pos, topic of the messages that have one already, as when messages were imported
    late: each burst sees what lies before it, wherever it was assigned. topics: chat, topic, state, closed_ms of the assigned
    ones. An active topic takes a burst if its last message before it is no more than the ttl before the burst's first; a closed
    one does if, besides, the whole burst lies before its closing; a merged one never. Topics that aren't listed are active.

    Methods: rule_reply, where the burst has replies to earlier messages and all of them are to one topic that takes it. Else, of
    the topics that take it, ranked by links and age (then the later active, the earlier begun), the best all_candidates_max, or
    candidate_k where there are more, are candidates. Without answers the first is taken if its score is at least `least`
    (candidate), else the burst begins a topic (new_topic). answers: chat, burst, choice (rank from 0, null for a new topic),
    confidence, review (rank, or null). A confidence under tau_low begins a topic; from tau_high on the choice holds (answer);
    between them the review decides (review). A rank beyond the candidates begins a topic. A burst with candidates and without
    an answer stays without a topic (unanswered).

    chunk: how many bursts the fold takes out of a batch at a time; it changes no result.
    """
    kind = msg.schema["chat"].dataType.simpleString()
    place = bursts.select("chat", "pos", "burst")
    rows = msg.where("NOT recalled").select("chat", "pos", "ms", "sender", F.coalesce("reply_pos", F.lit(0)).alias("reply"), F.coalesce(F.when(F.col("mention") != "all", F.col("mention")), F.lit("")).alias("mention")).join(place, ["chat", "pos"])
    # asked: the last burst that replies to a place of an earlier one.
    replied = rows.where("reply > 0 AND reply < pos").groupBy("chat", F.col("reply").alias("pos")).agg(F.max("burst").alias("asked"))
    rows = rows.join(replied, ["chat", "pos"], "left").withColumn("asked", F.when(F.col("asked") > F.col("burst"), F.col("asked")))
    nothing = F.lit(None).cast("bigint")
    if assigned is None:
        rows = rows.withColumns({"fixed": nothing, "until": nothing, "kept": nothing})
    else:
        begun = assigned.join(msg.select("chat", "pos", "ms"), ["chat", "pos"]).groupBy("chat", "topic").agg(F.min("pos").alias("fixed"), F.max("ms").alias("kept"))
        if topics is not None:
            begun = begun.join(topics.select("chat", "topic", "state", "closed_ms"), ["chat", "topic"], "left")
            until = F.when(F.col("state") == "closed", F.coalesce("closed_ms", F.lit(-(1 << 62)))).when(F.coalesce("state", F.lit("active")) != "active", -(1 << 62))
        begun = begun.select("chat", "topic", "fixed", "kept", (until if topics is not None else nothing).alias("until"))
        rows = rows.join(assigned.select("chat", "pos", "topic").join(begun, ["chat", "topic"]).drop("topic"), ["chat", "pos"], "left")
    member = F.struct("pos", "ms", "sender", "reply", "mention", "asked", "fixed", "until", "kept")
    each = rows.groupBy("chat", "burst").agg(F.array_sort(F.collect_list(member)).alias("m"))
    lost = msg.where("recalled").select("chat", "pos").join(place, ["chat", "pos"]).groupBy("chat", "burst").agg(F.collect_list("pos").alias("lost"))
    each = each.join(lost, ["chat", "burst"], "left")
    if answers is None:
        each = each.withColumns({"choice": nothing, "confidence": F.lit(None).cast("double"), "review": nothing})
    else:
        each = each.join(answers.select("chat", "burst", F.col("choice").cast("bigint").alias("choice"), F.col("confidence").cast("double").alias("confidence"), F.col("review").cast("bigint").alias("review")), ["chat", "burst"], "left")
    fields = [F.col(f"m.{c}") for c in ("pos", "ms", "sender", "reply", "mention")]
    # Most places are asked for by nobody and assigned to nothing: a null says so of a whole burst.
    fields += [F.when(F.size(F.array_compact(f"m.{c}")) > 0, F.col(f"m.{c}")).alias(c) for c in ("asked", "fixed", "until", "kept")]
    each = each.select("chat", "burst", *fields, "lost", "choice", "confidence", "review")
    answered = answers is not None

    def numbers(values, n: int) -> list:
        return [None] * n if values is None else [None if pd.isna(x) else int(x) for x in values]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, state = None, Chat()
        for pdf in batches:
            for lo in range(0, len(pdf), chunk):
                out = []
                for r in pdf.iloc[lo : lo + chunk].itertuples(index=False):
                    if r.chat != chat:
                        chat, state = r.chat, Chat()
                    pos, ms = r.pos.tolist(), r.ms.tolist()
                    asked, fixed = numbers(r.asked, len(pos)), numbers(r.fixed, len(pos))
                    start, end = ms[0], max(ms)
                    state.expire(start, p.topic_ttl_ms)
                    if r.fixed is not None:
                        until, kept = numbers(r.until, len(pos)), numbers(r.kept, len(pos))
                        for i, k in enumerate(fixed):
                            if k is not None:
                                if k not in state.live:
                                    state.live[k] = Topic(until[i], kept[i])
                                state.add(k, pos[i], ms[i], r.sender[i], asked[i])
                    else:
                        k, method = _choose(r, pos, state.live, state.at, start, end, p, least, answered)
                        out.append((chat, r.burst, k, method))
                        if k is not None:
                            if k not in state.live:
                                state.live[k] = Topic()
                            for i, x in enumerate(pos):
                                state.add(k, x, ms[i], r.sender[i], asked[i])
                    state.past(r.burst)
                told = pd.DataFrame(out, columns=["chat", "burst", "topic", "method"])
                yield told.astype({"topic": "Int64"})

    ordered = each.repartition("chat").sortWithinPartitions("chat", "burst")
    return ordered.mapInPandas(fold, f"chat {kind}, burst long, topic long, method string")


def _choose(r, pos: list[int], live: dict, at: dict, start: int, end: int, p: Params, least: float, answered: bool) -> tuple[int | None, str]:
    own = set(pos) | {int(x) for x in (r.lost if r.lost is not None else ())}
    replies = r.reply.tolist()
    outside = [x for x in replies if x and x not in own]
    targets = {at.get(x) for x in outside}
    if len(targets) == 1 and (only := targets.pop()) is not None and live[only].takes(start, end, p.topic_ttl_ms):
        return only, "rule_reply"
    open_ = [k for k, t in live.items() if t.takes(start, end, p.topic_ttl_ms)]
    new = pos[0]
    if not open_:
        return new, "new_topic"
    edges = dict.fromkeys(open_, 0)
    for reply, mention in zip(replies, r.mention):
        replied = at.get(reply) if reply and reply not in own else None
        if mention:
            for k in open_:
                edges[k] += k == replied or mention in live[k].senders
        elif replied in edges:
            edges[replied] += 1
    score = {k: round(p.beta * min(edges[k], 3) / 3.0 - p.gamma * (start - live[k].last) / p.topic_ttl_ms, 9) for k in open_}
    rank = lambda k: (-score[k], -live[k].last, k)
    if not answered:
        best = min(open_, key=rank)
        return (best, "candidate") if score[best] >= least else (new, "new_topic")
    ranked = sorted(open_, key=rank)
    if len(ranked) > p.all_candidates_max:
        del ranked[p.candidate_k :]
    if pd.isna(r.confidence):
        return None, "unanswered"
    pick = lambda c: ranked[int(c)] if pd.notna(c) and 0 <= c < len(ranked) else None
    if pd.isna(r.choice) or r.confidence < p.tau_low:
        return new, "new_topic"
    chosen, method = (pick(r.choice), "answer") if r.confidence >= p.tau_high else (pick(r.review), "review")
    return (chosen, method) if chosen is not None else (new, "new_topic")
