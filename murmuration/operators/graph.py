"""Alias roots, merge closure, greedy one-to-one matching."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import forget, written


def alias_root(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root for rows (node, parent), parent null at a root. Pointers double each round, so depth d takes log d rounds."""
    at = written(parents.select("node", F.coalesce("parent", "node").alias("up")), "up")
    for _ in range(rounds):
        up = at.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = at.select("node", "up").join(up, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
        moved, old = written(moved, "up"), at
        forget(old)
        at = moved
        if not moved.where("moved").take(1):
            break
    return at.select("node", F.col("up").alias("root"))


def _components(pairs: DataFrame) -> DataFrame:
    """node, root (the smallest id that pairs (a, b) reach), for nodes in pairs: minima pass along pairs, pointers are followed."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.union(both.select("v", "u")).distinct(), "pairs")
    at = written(both.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "roots")
    while True:
        near = both.join(at, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("low"))
        new = at.join(near, F.col("node") == F.col("u")).select("node", "root", F.least("root", "low").alias("low"))
        up = new.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new, old = written(new.join(up, "low").select("node", F.least("low", "next").alias("root"), (F.least("low", "next") != F.col("root")).alias("moved")), "roots"), at
        forget(old)
        at = new
        if not new.where("moved").take(1):
            forget(both)
            return at.select("node", "root")


def merge_closure(supports: DataFrame, rejected: DataFrame | None = None, least: int = 2, at_once: int = 200_000) -> DataFrame:
    """node, root for the nodes of supports (a, b, support; a < b): where each topic is after all merges, itself if it stays.

    Two topics merge if their support reaches least and, where supports has in_scope, some of it is in scope; the smaller id
    stays. Supports of a common neighbour add, scopes are or-ed, so a merge may bring up a pair that had too little. Pairs in
    rejected (a, b) don't merge, nor do the topics that they have become part of. The result is that of merging one pair at a
    time, always the one with most support, of equal ones that with the smaller ids.

    Topics that no support joins never meet, so each component is solved alone. Without a rejected pair inside, the order
    does not matter there: rounds contract all pairs that have enough. With one, a component of at_once pairs at most is
    contracted best-first in one task; a larger one loses its safe pairs first (see _safe), round by round.
    """
    scoped = "in_scope" in supports.columns
    scope = F.bool_or(F.coalesce("in_scope", F.lit(False))) if scoped else F.lit(True)
    pairs = supports.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(c for c in supports.columns if c in ("support", "in_scope"))).where("a < b")
    edges = written(pairs.groupBy("a", "b").agg(F.sum("support").alias("support"), scope.alias("in_scope")), "supports")
    roots = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    if rejected is None:
        return _moved(roots, _contracted(edges, least))
    blocked = written(rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "blocked")
    while True:
        edges, old = written(edges.join(blocked, ["a", "b"], "left_anti"), "supports"), edges  # a rejected pair stays one, whatever its sides become
        forget(old)
        if not edges.take(1):
            return roots
        part = _components(edges).select(F.col("node").alias("a"), F.col("root").alias("part"))
        there = part.select(F.col("a").alias("b"), F.col("part").alias("_other"))
        inside = blocked.join(part, "a").join(there, "b").where("part = _other").drop("_other")
        sized = edges.join(part, "a")
        parts = sized.groupBy("part").agg(F.count("*").alias("n")).join(inside.groupBy("part").agg(F.count("*").alias("r")), "part", "left")
        parts = written(parts.select("part", F.when(F.col("r").isNull(), "free").when(F.col("n") + F.col("r") <= at_once, "small").otherwise("large").alias("kind")), "parts")
        sized, inside = written(sized.join(parts, "part"), "sized"), written(inside.join(parts, "part"), "inside")
        pick = lambda rows, kind: rows.where(F.col("kind") == kind).drop("kind")
        moves = _contracted(pick(sized, "free").drop("part"), least)
        moves = moves.union(_best_first(pick(sized, "small"), pick(inside, "small"), least))
        large = pick(sized, "large")
        more = large.take(1)
        if more:
            safe = written(_safe(large, least), "safe")
            more = safe.take(1)
            moves = moves.union(safe)
        moves = written(moves, "moves")
        roots, old = _moved(roots, moves), (roots, edges, blocked, sized, inside, parts)
        if not more:
            forget(*old)
            return roots
        edges = written(_renamed(large.drop("part"), moves, "support", "in_scope").groupBy("a", "b").agg(F.sum("support").alias("support"), F.bool_or("in_scope").alias("in_scope")), "supports")
        blocked = written(_renamed(pick(inside, "large"), moves).distinct(), "blocked")
        forget(*old)


def _renamed(rows: DataFrame, moves: DataFrame, *keep: str) -> DataFrame:
    for side in "ab":
        rows = rows.join(moves.select(F.col("node").alias(side), F.col("root").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *keep)


def _moved(roots: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def _contracted(edges: DataFrame, least: int) -> DataFrame:
    """node, root after all merges where nothing is rejected: supports only grow, so the order does not matter."""
    edges = written(edges, "supports")
    moves = written(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false"), "moves")
    while True:
        ready = written(edges.where((F.col("support") >= least) & F.col("in_scope")).select("a", "b"), "ready")
        if not ready.take(1):
            forget(ready, edges)
            return moves
        new = written(_components(ready), "new")
        old = (edges, moves, ready)
        edges = written(_renamed(edges, new, "support", "in_scope").groupBy("a", "b").agg(F.sum("support").alias("support"), F.bool_or("in_scope").alias("in_scope")), "supports")
        kept = moves.join(new.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        moves = written(kept.union(new.join(moves, "node", "left_anti")), "moves")
        forget(*old)


def _safe(edges: DataFrame, least: int) -> DataFrame:
    """node, root for pairs that one-by-one merging merges as they are now, and for the best pair of each component.

    A pair is safe if its support is more than all other support of each side, and than all support of each neighbour. Until
    it has its turn only pairs with at least its support merge. None of them can be at a side or a neighbour, as what a topic
    has in all bounds what it has with any group of others. So nothing near the pair changes before its turn, and what comes
    of it ranks behind it: merging it at once changes no choice before.
    """
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w"), "support").union(edges.select("b", "a", "support"))
    total = written(ends.groupBy("v").agg(F.sum("support").alias("all")), "totals")
    near = ends.join(total.withColumnRenamed("v", "w"), "w")
    first = near.groupBy("v").agg(F.max(F.struct("all", "w")).alias("first"))
    other = near.join(first, "v").where("w <> first.w").groupBy("v").agg(F.max("all").alias("second"))
    seen = first.join(other, "v", "left").join(total, "v").select("v", "all", "first", F.coalesce("second", F.lit(0)).alias("second"))
    ready = edges.where((F.col("support") >= least) & F.col("in_scope"))
    for side, far in (("a", "b"), ("b", "a")):
        # The heaviest neighbour of a side, but for the other side.
        s = seen.select(F.col("v").alias(side), F.col("all").alias(f"all_{side}"), F.col("first").alias(f"f_{side}"), F.col("second").alias(f"s_{side}"))
        ready = ready.join(s, side).withColumn(f"near_{side}", F.when(F.col(f"f_{side}.w") == F.col(far), F.col(f"s_{side}")).otherwise(F.col(f"f_{side}.all")))
    rest = [F.col("all_a") - F.col("support"), F.col("all_b") - F.col("support"), F.col("near_a"), F.col("near_b")]
    safe = ready.where(F.greatest(*rest) < F.col("support")).select("a", "b")
    order = F.struct(-F.col("support"), "a", "b")
    best = ready.groupBy("part").agg(F.min(order).alias("o")).select("o.a", "o.b")
    return safe.union(best).distinct().select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("root")), F.struct(F.col("b").alias("node"), F.col("a").alias("root")))).alias("m")).select("m.*").distinct()


def _best_first(edges: DataFrame, blocked: DataFrame, least: int) -> DataFrame:
    """node, root of small components (part, a, b, support, in_scope), each merged one pair at a time in one task."""
    kind = edges.schema["a"].dataType.simpleString()
    rows = edges.select("part", "a", "b", "support", "in_scope").union(blocked.select("part", "a", "b", F.lit(None).cast("bigint"), F.lit(None).cast("boolean")))

    def contract(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}  # of each topic: neighbour -> [support, in scope]
        apart: dict = {}
        for a, b, n, scope in zip(pdf["a"], pdf["b"], pdf["support"], pdf["in_scope"]):
            if pd.isna(n):
                apart.setdefault(a, set()).add(b)
                apart.setdefault(b, set()).add(a)
            else:
                near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = [int(n), bool(scope)]
        up: dict = {}
        may = lambda a, b: near[a][b][0] >= least and near[a][b][1] and b not in apart.get(a, ())
        queue = [(-e[0], a, b) for a, es in near.items() for b, e in es.items() if a < b and may(a, b)]
        heapq.heapify(queue)
        while queue:
            n, a, b = heapq.heappop(queue)
            if a in up or b in up or b not in near[a] or near[a][b][0] != -n or not may(a, b):
                continue  # another pair by now
            up[b] = a
            del near[a][b]
            lost = near.pop(b)
            for c in apart.pop(b, set()):
                apart[c].discard(b)
                apart[c].add(a)
                apart.setdefault(a, set()).add(c)
            for c, e in lost.items():
                if c == a:
                    continue
                del near[c][b]
                mine = near[a].setdefault(c, near[c].setdefault(a, [0, False]))
                mine[0] += e[0]
                mine[1] |= e[1]
                if may(*sorted((a, c))):
                    heapq.heappush(queue, (-mine[0], *sorted((a, c))))
        nodes = sorted({*pdf["a"], *pdf["b"]})
        out = []
        for x in nodes:
            while x in up:
                x = up[x]
            out.append(x)
        return pd.DataFrame({"node": nodes, "root": out})

    return rows.groupBy("part").applyInPandas(contract, f"node {kind}, root {kind}")


def match_greedy(candidates: DataFrame, at_once: int = 100_000, rounds: int = 1) -> DataFrame:
    """One-to-one matches of (run, pred, gold, overlap, rank), best first: overlap, then rank, then pred, then gold.

    Under one strict order greedy choice equals taking, round by round, all pairs that are the best of both their sides. A
    run with at_once pairs at most is finished in one task, in order. Larger ones shrink by rounds; as a long chain of pairs
    takes a round a pair, what is left after the given rounds is read as a stream in that order, one task a run, which keeps
    the matched items only.
    """
    left, out = written(candidates.select("run", "pred", "gold", "overlap", "rank"), "left"), None
    order = [F.desc("overlap"), F.col("rank"), F.col("pred"), F.col("gold")]
    kinds = {c: left.schema[c].dataType.simpleString() for c in ("run", "pred", "gold", "overlap")}

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        preds, golds, keep = set(), set(), []
        pdf = pdf.sort_values(["overlap", "rank", "pred", "gold"], ascending=[False, True, True, True])
        for i, p, g in zip(pdf.index, pdf["pred"], pdf["gold"]):
            if p not in preds and g not in golds:
                preds.add(p)
                golds.add(g)
                keep.append(i)
        return pdf.loc[keep, ["run", "pred", "gold", "overlap"]]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, preds, golds = None, set(), set()
        for pdf in batches:
            keep = []
            for i, (r, p, g) in enumerate(zip(pdf["run"], pdf["pred"], pdf["gold"])):
                if r != run:
                    run, preds, golds = r, set(), set()
                if p not in preds and g not in golds:
                    preds.add(p)
                    golds.add(g)
                    keep.append(i)
            yield pdf.iloc[keep]

    for left_rounds in range(rounds, -1, -1):
        sizes = left.groupBy("run").agg(F.count("*").alias("_n"))
        small, large = (left.join(sizes.where(c), "run", "left_semi") for c in (F.col("_n") <= at_once, F.col("_n") > at_once))
        done = written(small.groupBy("run").applyInPandas(finish, ", ".join(f"{c} {k}" for c, k in kinds.items())), "done")
        out = done if out is None else out.union(done)
        large, old = written(large, "large"), left
        forget(old)
        if not large.take(1):
            forget(large)
            return out
        if not left_rounds:
            rest = large.repartition("run").sortWithinPartitions("run", *order).select("run", "pred", "gold", "overlap")
            return out.union(rest.mapInPandas(stream, ", ".join(f"{c} {k}" for c, k in kinds.items())))
        best = large.withColumns({
            "p": F.row_number().over(Window.partitionBy("run", "pred").orderBy(*order)), "g": F.row_number().over(Window.partitionBy("run", "gold").orderBy(*order)),
        }).where("p = 1 and g = 1").select("run", "pred", "gold", "overlap")
        best = written(best, "best")
        out = out.union(best)
        left = written(large.join(best.select("run", "pred"), ["run", "pred"], "left_anti").join(best.select("run", "gold"), ["run", "gold"], "left_anti"), "left")
        forget(large)
