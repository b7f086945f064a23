"""Online assignment against a plain loop over whole lists of messages."""

import random

import pytest

from murmuration.operators.assign import assign_online
from murmuration.params import Params

P = Params(topic_ttl_ms=100, beta=0.3, gamma=0.1)


def looped(rows, least):
    """rows: (chat, pos, burst, ms, sender, recalled, reply_pos, mention) in order."""
    told, topic_of = {}, {}
    for chat, burst in dict.fromkeys((r[0], r[2]) for r in rows):
        members = [r for r in rows if r[0] == chat and r[2] == burst]
        shown = [r for r in members if not r[5]]
        if not shown:
            continue
        start = shown[0][3]
        done = {t: [r for r in rows if topic_of.get((chat, r[1])) == t and r[0] == chat] for t in {t for (c, _), t in topic_of.items() if c == chat}}
        open_ = {t: ms for t, ms in ((t, max(r[3] for r in rs)) for t, rs in done.items()) if start - ms <= P.topic_ttl_ms}
        outside = [r[6] for r in shown if r[6] is not None and r[6] not in {m[1] for m in members}]
        targets = {topic_of.get((chat, x)) for x in outside}
        if len(targets) == 1 and (t := next(iter(targets))) in open_:
            choice = (t, "rule_reply")
        else:
            ranked = []
            for t, ms in open_.items():
                links = sum(1 for r in shown if r[6] in {d[1] for d in done[t]} or r[7] in {d[4] for d in done[t]})
                ranked.append((-round(0.3 * min(links, 3) / 3.0 - 0.1 * (start - ms) / 100, 9), -ms, t))
            ranked.sort()
            choice = (ranked[0][2], "candidate") if ranked and -ranked[0][0] >= least else (shown[0][1], "new_topic")
        told[chat, burst] = choice
        topic_of.update({(chat, r[1]): choice[0] for r in shown})
    return told


@pytest.mark.parametrize("least", [-1.0, 0.0, 0.05])
def test_assign_online(spark, least):
    rnd = random.Random(11)
    rows, pos = [], 0
    for chat in (1, 2):
        ms, burst = 0, 1
        for pos in range(1, 260):
            if rnd.random() < 0.4:
                burst = pos
            ms += rnd.choice([0, 5, 5, 20, 100, 101]) if rnd.random() < 0.95 else 400
            reply = rnd.choice([None, None, pos - rnd.randint(1, 12), pos + 1])
            rows.append((chat, pos, burst, ms, f"u{rnd.randint(0, 6)}", rnd.random() < 0.15, reply, rnd.choice([None, None, "all", f"u{rnd.randint(0, 8)}"])))
    df = spark.createDataFrame(rows, "chat long, pos long, burst long, ms long, sender string, recalled boolean, reply_pos long, mention string")
    df = df.withColumn("ordinal", df["pos"])
    for chunk in (500, 25):
        got = {(r.chat, r.burst): (r.topic, r.method) for r in assign_online(df.drop("burst"), df.select("chat", "pos", "burst"), P, least, chunk=chunk).collect()}
        assert got == looped(rows, least)
    if least == 0.0:
        assert {m for _, m in got.values()} == {"rule_reply", "candidate", "new_topic"}


def test_assign_nothing(spark):
    df = spark.createDataFrame([], "chat long, pos long, burst long, ms long, sender string, recalled boolean, reply_pos long, mention string, ordinal long")
    assert assign_online(df.drop("burst"), df.select("chat", "pos", "burst"), P).count() == 0


def late(rows, fixed, states, answers, least):
    """Late bursts in order among assigned messages. fixed: (chat, pos) -> topic; states: (chat, topic) -> (state, closed_ms)."""
    first = {}
    for (c, pos), t in fixed.items():
        first[c, t] = min(pos, first.get((c, t), pos))
    topic_of = {k: first[k[0], t] for k, t in fixed.items()}
    state = {(c, first[c, t]): s for (c, t), s in states.items() if (c, t) in first}
    by_place, told = {(r[0], r[1]): r for r in rows}, {}
    for chat, burst in dict.fromkeys((r[0], r[2]) for r in rows if not r[5] and (r[0], r[1]) not in fixed):
        members = [r for r in rows if r[0] == chat and r[2] == burst]
        shown = [r for r in members if not r[5]]
        start, end, own = shown[0][3], max(r[3] for r in shown), {r[1] for r in members}
        before = [(by_place[k], t) for k, t in topic_of.items() if k[0] == chat and k[1] < shown[0][1] and not by_place[k][5]]
        open_ = {}
        for t in {t for _, t in before}:
            kind, closed = state.get((chat, t), ("active", None))
            ms = max(r[3] for r, x in before if x == t)
            if start - ms <= P.topic_ttl_ms and (kind == "active" or kind == "closed" and end < closed):
                open_[t] = ms
        place = {r[1]: t for r, t in before}
        targets = {place.get(r[6]) for r in shown if r[6] is not None and r[6] not in own}
        if len(targets) == 1 and (t := next(iter(targets))) in open_:
            choice = (t, "rule_reply")
        else:
            ranked = []
            for t, ms in open_.items():
                links = sum(1 for r in shown if place.get(r[6]) == t and r[6] not in own or r[7] in {d[4] for d, x in before if x == t})
                ranked.append((-round(0.3 * min(links, 3) / 3.0 - 0.1 * (start - ms) / 100, 9), -ms, t))
            ranked.sort()
            choice = (shown[0][1], "new_topic")
            if answers is None and ranked and -ranked[0][0] >= least:
                choice = (ranked[0][2], "candidate")
            elif answers is not None and ranked:
                pick, sure, review = answers.get((chat, burst), (None, None, None))
                if sure is None:
                    choice = (None, "unanswered")
                elif pick is not None and sure >= 0.25:
                    at, method = (pick, "answer") if sure >= 0.6 else (review, "review")
                    if at is not None and at < len(ranked):
                        choice = (ranked[at][2], method)
        told[chat, burst] = choice
        if choice[0] is not None:
            topic_of.update({(chat, r[1]): choice[0] for r in shown})
    return told


@pytest.mark.parametrize("seed,asked", [(1, False), (2, False), (3, True), (4, True)])
def test_late_bursts_and_states(spark, seed, asked):
    rnd, rows, fixed = random.Random(seed), [], {}
    for chat in (1, 2):
        ms, burst, old, current = 0, 1, True, 0
        for pos in range(1, 300):
            if rnd.random() < 0.35:
                burst, old, current = pos, rnd.random() < 0.6, rnd.randint(0, 9)
            ms += rnd.choice([0, 5, 5, 20, 60, 101])
            gone = rnd.random() < 0.1
            rows.append((chat, pos, burst, ms, f"u{rnd.randint(0, 6)}", gone, rnd.choice([None, None, pos - rnd.randint(1, 40)]), rnd.choice([None, None, "all", f"u{rnd.randint(0, 8)}"])))
            if old and not gone:
                fixed[chat, pos] = f"t{current}"
    # A burst of which some message is assigned is assigned.
    taken = {(r[0], r[2]) for r in rows if (r[0], r[1]) in fixed}
    fixed.update({(r[0], r[1]): next(fixed[q[0], q[1]] for q in rows if (q[0], q[2]) == (r[0], r[2]) and (q[0], q[1]) in fixed) for r in rows if (r[0], r[2]) in taken and not r[5] and (r[0], r[1]) not in fixed})
    states = {(c, f"t{k}"): rnd.choice([("active", None), ("closed", rnd.randint(500, 8000)), ("merged", None)]) for c in (1, 2) for k in range(8)}
    answers = {(r[0], r[2]): (rnd.choice([None, 0, 0, 1, 7]), rnd.choice([0.1, 0.25, 0.4, 0.6, 0.9]), rnd.choice([None, 0, 1])) for r in rows if rnd.random() < 0.8} if asked else None
    df = spark.createDataFrame(rows, "chat long, pos long, burst long, ms long, sender string, recalled boolean, reply_pos long, mention string")
    have = spark.createDataFrame([(*k, t) for k, t in fixed.items()], "chat long, pos long, topic string")
    known = spark.createDataFrame([(*k, *s) for k, s in states.items()], "chat long, topic string, state string, closed_ms long")
    said = spark.createDataFrame([(*k, *a) for k, a in answers.items()], "chat long, burst long, choice long, confidence double, review long") if asked else None
    want = late(rows, fixed, states, answers, 0.0)
    for chunk in (300, 25):
        got = {(r.chat, r.burst): (r.topic, r.method) for r in assign_online(df.drop("burst"), df.select("chat", "pos", "burst"), P, 0.0, have, known, said, chunk).collect()}
        assert got == want
    assert {m for _, m in want.values()} >= ({"unanswered", "answer", "review", "new_topic"} if asked else {"candidate", "rule_reply", "new_topic"})


def test_a_chat_is_folded_once(spark):
    """Chunks that all rest on the one before took a round of jobs each."""
    rows = [(1, pos, pos, pos * 5, f"u{pos}", False, pos - 9, None) for pos in range(1, 200)]
    df = spark.createDataFrame(rows, "chat long, pos long, burst long, ms long, sender string, recalled boolean, reply_pos long, mention string")
    spark.sparkContext.setJobGroup("folded-once", "assign_online")
    try:
        got = {r.burst: r.topic for r in assign_online(df.drop("burst"), df.select("chat", "pos", "burst"), P, 1.0, chunk=3).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("folded-once"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {pos: (pos - 1) % 9 + 1 for pos in range(1, 200)} and jobs < 40


def test_places_nobody_asks_for_are_forgotten():
    from murmuration.operators.assign import Chat, Topic

    chat = Chat()
    chat.live[1] = Topic()
    for pos in range(1, 1000):
        chat.add(1, pos, pos, "u", pos + 2 if pos % 3 == 0 else None)
        chat.past(pos)
    assert set(chat.at) == {999} == chat.live[1].places and len(chat.ends) == 1
