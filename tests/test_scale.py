"""Operators whose groups are a share of the whole table, against plain loops."""

import collections
import random

import pytest


@pytest.fixture
def many_partitions(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_preference_weights_in_runs(spark, many_partitions):
    from murmuration.operators.rank import preference_weights

    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "hot", "cold", None]), rnd.randint(0, 500), str(i), rnd.choice([1, 1, -1, 0])) for i in range(900)]
    want = {}
    for f, _, _, label in sorted(rows, key=lambda r: (r[1], r[2])):
        w, n = want.get(f, (0.0, 0))
        want[f] = (w * 0.95 if label == 0 else max(-0.5, min(0.5, w * 0.95 + 0.2 * label)), n + 1)
    votes = spark.createDataFrame(rows, "feature string, at long, tie string, label int")
    plan = preference_weights(votes)
    assert {r.feature: (r.weight, r.events) for r in plan.collect()} == {f: (round(w, 9), n) for f, (w, n) in want.items()}


def test_every_insight_votes(spark, sf):
    from murmuration.plans.views import view
    from murmuration.queries import QUERIES

    want = collections.Counter()
    for r in view(spark, sf, "v_insight").select("kind", "topic_id", "bound_date").collect():
        want.update([f"kind:{r.kind}", f"topic:{r.topic_id}", f"deadline:{str(r.bound_date is not None).lower()}"])
    assert {r.feature: r.events for r in QUERIES["preference_weights_all"](spark, sf).collect()} == want


def test_match_on_whole_keys(spark, sf):
    from murmuration.plans.views import view
    from murmuration.queries import QUERIES

    rows = collections.Counter((r.l_linenumber, r.l_partkey, r.l_suppkey) for r in view(spark, sf, "lineitem").select("l_linenumber", "l_partkey", "l_suppkey").collect())
    preds, golds, want = set(), set(), set()
    for (run, pred, gold), n in sorted(rows.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if (run, pred) not in preds and (run, gold) not in golds:
            preds.add((run, pred)), golds.add((run, gold)), want.add((run, pred, gold, n))
    assert {(r.run, r.pred, r.gold, r.overlap) for r in QUERIES["match_greedy"](spark, sf).collect()} == want


def test_bursts_in_chunks(spark, sf):
    from murmuration.operators.segment import bursts
    from murmuration.params import Params

    rnd = random.Random(4)
    p = Params(weak_gap_ms=30, strong_gap_ms=200, same_sender_ms=60, burst_max=5)
    rows, want = [], {}
    for chat in range(3):
        ms, start, size, last = 0, 0, 0, None
        for pos in range(1, 400 if chat else 41):
            ms += rnd.choice([1, 10, 10, 29, 31, 50, 90, 250]) if chat < 2 else 1
            sender, reply = rnd.choice("ab"), rnd.choice([None, max(1, pos - rnd.randint(1, 6))])
            gap = ms - last[0] if last else 0
            joins = last and size < 5 and gap < 200 and (gap < 30 or start <= (reply or 0) < pos or sender == last[1] and gap <= 60)
            start, size = (start, size + 1) if joins else (pos, 1)
            last = ms, sender
            rows.append((chat, pos, ms, sender, f"m{chat}_{pos}", reply))
            want[f"m{chat}_{pos}"] = start
    msg = spark.createDataFrame(rows, "chat long, pos long, ms long, sender string, message_id string, reply_pos long")
    for chunk in (5, 7, 20, 1000):
        assert {r.message_id: r.burst for r in bursts(msg, p, chunk).collect()} == want, chunk


def test_places_without_a_sort_of_a_chat(spark, sf):
    from murmuration.plans.views import _events

    got = _events(spark, sf)  # as it is made; queries read it as written
    places = collections.defaultdict(list)
    for r in got.orderBy("ms", "event_id").collect():
        places[r.chat].append(r.pos)
    assert len(places) > 10 and all(p == list(range(1, len(p) + 1)) for p in places.values())
    # Events are numbered within spans, not within a chat.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(chat" in plan and "_span" in plan.split("row_number() windowspecdefinition(chat")[1].split(",")[1]


def merged_one_by_one(supports, rejected=(), scope=None):
    """Merge the best pair, add up, repeat. scope: the pairs with some support in scope; all, if not given."""
    edges, root, blocked = dict(supports), {}, {frozenset(p) for p in rejected}
    scope = {frozenset(p) for p in (supports if scope is None else scope)}
    while True:
        ready = [(-n, a, b) for (a, b), n in edges.items() if n >= 2 and frozenset((a, b)) not in blocked and frozenset((a, b)) in scope]
        if not ready:
            break
        _, into, gone = min(ready)
        root[gone] = into
        name = lambda x: into if x == gone else x
        blocked = {q for q in (frozenset(map(name, p)) for p in blocked) if len(q) == 2}
        scope = {frozenset(map(name, p)) for p in scope}
        new = collections.Counter()
        for (a, b), n in edges.items():
            a, b = sorted((name(a), name(b)))
            if a != b:
                new[a, b] += n
        edges = new
    out = {}
    for x in {x for p in supports for x in p}:
        out[x] = x
        while out[x] in root:
            out[x] = root[out[x]]
    return out


def test_merges_bring_up_new_pairs(spark):
    from murmuration.operators.graph import merge_closure

    rnd = random.Random(6)
    for trial in range(4):
        supports = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1} if not trial else {}
        for _ in range(60 * bool(trial)):
            a, b = sorted(rnd.sample(range(40), 2))
            supports[f"t{a:02d}", f"t{b:02d}"] = rnd.choice([1, 1, 1, 2])
        df = spark.createDataFrame([(a, b, n) for (a, b), n in supports.items()], "a string, b string, support long")
        want = merged_one_by_one(supports)
        assert {r.node: r.root for r in merge_closure(df).collect()} == want
        assert trial or want["c"] == "a"
    # A pair that is best for both its sides now may be beaten once stronger pairs elsewhere have merged.
    supports = {("c", "d"): 10, ("a", "b"): 5, ("a", "c"): 3, ("a", "d"): 3}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in supports.items()], "a string, b string, support long")
    got = {r.node: r.root for r in merge_closure(df, spark.createDataFrame([("c", "b")], "a string, b string")).collect()}
    assert got == merged_one_by_one(supports, [("b", "c")]) == {"a": "a", "b": "b", "c": "a", "d": "a"}
    rejected = [("a", "c")]
    supports = {("a", "b"): 3, ("b", "c"): 2, ("c", "d"): 2}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in supports.items()], "a string, b string, support long")
    got = {r.node: r.root for r in merge_closure(df, spark.createDataFrame(rejected, "a string, b string")).collect()}
    assert got == merged_one_by_one(supports, rejected) == {"a": "a", "b": "a", "c": "c", "d": "c"}


@pytest.mark.parametrize("at_once,graphs", [(10_000, 60), (4, 8)])
def test_merges_with_rejections_and_scope(spark, at_once, graphs):
    """Random graphs with rejections, scopes and ties; small components in one task, large ones by safe pairs first."""
    from murmuration.operators.graph import merge_closure

    rnd, supports, rejected, scope, want = random.Random(8), {}, [], [], {}
    for g in range(graphs):
        n = rnd.choice([4, 8, 12, 30]) if graphs > 8 else 6
        name = lambda i: f"g{g:02d}-{i:02d}"
        mine = {tuple(sorted((name(a), name(b)))): rnd.choice([1, 1, 2, 3, 5, 20, 60]) for a, b in (rnd.sample(range(n), 2) for _ in range(rnd.randint(n, 2 * n)))}
        away = [rnd.choice([p, p[::-1]]) for p in {tuple(sorted((name(a), name(b)))) for a, b in (rnd.sample(range(n), 2) for _ in range(g % 7))}]
        near = [p for p in mine if g % 2 or rnd.random() < 0.6]
        want |= merged_one_by_one(mine, away, near)
        supports |= mine
        rejected += away
        scope += near
    scope = set(scope)
    df = spark.createDataFrame([(a, b, n, (a, b) in scope or None) for (a, b), n in supports.items()], "a string, b string, support long, in_scope boolean")
    got = {r.node: r.root for r in merge_closure(df, spark.createDataFrame(rejected, "a string, b string"), at_once=at_once).collect()}
    assert got == want


def test_greedy_matches_with_ties(spark):
    from murmuration.operators.graph import match_greedy

    rnd = random.Random(7)
    rows = {(run, p, g): rnd.randint(1, 3) for run in "xy" for p in range(12) for g in range(9) if rnd.random() < 0.5}
    df = spark.createDataFrame([(run, p, g, n, p // 3) for (run, p, g), n in rows.items()], "run string, pred long, gold long, overlap long, rank long")
    preds, golds, want = set(), set(), set()
    for (run, p, g), n in sorted(rows.items(), key=lambda x: (x[0][0], -x[1], x[0][1] // 3, x[0][1], x[0][2])):
        if (run, p) not in preds and (run, g) not in golds:
            preds.add((run, p)), golds.add((run, g)), want.add((run, p, g, n))
    for at_once in (1000, 20, 0):
        assert {(r.run, r.pred, r.gold, r.overlap) for r in match_greedy(df, at_once).collect()} == want


def test_best_threads(spark):
    import itertools

    import numpy as np

    from murmuration.operators.insights import best_assignment, one_to_one

    rnd = np.random.default_rng(9)
    for _ in range(400):
        n, m = sorted(rnd.integers(1, 7, 2))
        w = rnd.integers(0, 9, (n, m))
        got = best_assignment([(i, j, int(w[i, j])) for i in range(n) for j in range(m) if w[i, j]])
        assert len(set(got.values())) == len(got) and sum(w[i, j] for i, j in got.items()) == max(w[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), int(n)))
    rows = [("a", p, g) for p, g, n in (("1", "x", 3), ("1", "y", 4), ("2", "y", 5), ("3", "x", 1)) for _ in range(n)] + [("b", str(i), "z") for i in range(6)]
    got = {r.chat: r for r in one_to_one(spark.createDataFrame(rows, "chat string, p string, g string"), most=5).collect()}
    assert (got["a"].matched, got["a"].total, got["a"].status) == (8, 13, "ok") and got["b"].matched is None and got["b"].status == "unavailable_too_many_threads"


def test_relation_shapes(spark):
    from murmuration.operators.contracts import relation_valid

    msg = spark.createDataFrame([("c", "m1", 1, 1, "can you come today", False), ("c", "m2", 2, 2, "yes of course", False), ("c", "m3", 3, 3, "gone", True), ("d", "m4", 9, 4, "yes of course", False)], "chat string, message_id string, ms long, ordinal long, text string, recalled boolean")
    rows = [
        ("ok question", "c", "question", "m1", "you come", None, None, None), ("short", "c", "question", "m1", " y o ", None, None, None), ("ok answer", "c", "answers", "m1", "youcome", "m2", "yes", "full"),
        ("no completeness", "c", "answers", "m1", "you", "m2", "yes", None), ("backwards", "c", "answers", "m2", "yes", "m1", "can", "full"), ("recalled", "c", "replaces", "m1", "can", "m3", "gone", None),
        ("another chat", "c", "conflicts", "m1", "can", "m4", "yes", None), ("ok conflict", "c", "conflicts", "m1", "can", "m2", "course", None), ("strange", "c", "praises", "m1", "can", "m2", "yes", None),
    ]
    rel = spark.createDataFrame(rows, "rel_id string, chat string, kind string, source_id string, quote string, target_id string, target_quote string, completeness string")
    assert {r.rel_id: r.valid for r in relation_valid(rel, msg).collect()} == {r[0]: r[0].startswith("ok") for r in rows}


def test_candidates_take_more_tasks_on_more_rows(spark, monkeypatch):
    from murmuration.operators import scores

    rnd = random.Random(6)
    sides = [[(rnd.randint(0, 9), rnd.choice("ab"), rnd.randint(0, 30)) for _ in range(700)] + [(1, None, 3), (1, "a", None)] for _ in range(2)]
    want = collections.Counter((p, g) for p, k, m in set(sides[0]) for g, kind, n in set(sides[1]) if None not in (k, m) and (k, m) == (kind, n))
    monkeypatch.setattr(scores, "TASK_ROWS", 50, raising=False)
    out = scores.match_candidates(*(spark.createDataFrame(s, "item long, kind string, message_id long") for s in sides))
    assert {(r.pred, r.gold): r.overlap for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [kind") == 2 and plan.count("], 29") == 2
