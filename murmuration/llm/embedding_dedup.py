"""Exact near-duplicate links between embeddings: a metric range join on the unit sphere.

Equal vectors collapse first. Pivots of a label split its vectors into cells, every vector at home with its nearest pivot.
A vector v is copied to the cell of pivot p only if it may lie within the radius r of a vector at home there. The
triangle inequality gives d(v, p) - d(v, home) <= 2 r for that; on the sphere the distance of v from the plane between
the two pivots bounds it more tightly, and that bound is used. Cells are then joined independently, in tiles of bounded
size, so a cell that holds a third of all vectors is many tasks; in a tile the distances from all pivots of the label leave
out what can't be near. A tile gives sums per vector and the edges of a
spanning forest, never its pairs.

Each label has pivots of its own, two at least if it has more than PIVOT_ROWS vectors; how many pay is estimated from a
bounded sample of the label. The PIVOT_LABELS largest labels are sampled; the smaller ones of more labels than that are
one cell each, in tiles. Any choice of pivots gives the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, numpy_components

SAMPLE = 20_000  # vectors, over all labels
PIVOT_LABELS = 256
PIVOT_ROWS = 32
MAX_PIVOTS = 64
TILE = 2048
BAND = 128


def _choose_pivots(sample: np.ndarray, rows: int, radius: float) -> np.ndarray:
    """Farthest-first pivots, two at least, as many as make the estimated work least."""
    best, least = sample[:1], math.inf
    order, far = [0], np.full(len(sample), math.inf)
    while len(order) < min(MAX_PIVOTS, len(sample)):
        far = np.minimum(far, 1 - sample @ sample[order[-1]])
        if far.max() < 1e-3:
            break
        order.append(int(far.argmax()))
    k = 1
    while k <= len(order):
        pivots = sample[order[:k]]
        home, member = _cells(sample, pivots, radius)
        f, g = np.bincount(home, minlength=k) / len(sample), member.mean(0)
        dim = sample.shape[1]
        work = rows * rows * float(f @ g) * dim / 4e9 + rows * float(g.sum()) * dim * 8 / 4e7
        if work < least or k == 2:
            best, least = pivots, work
        k *= 2
    return best


def _cells(v: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and in which cells it must be present."""
    dots = v @ pivots.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(-1), 1e-30))[home]
    near = (dots[np.arange(len(v)), home][:, None] - dots) / apart <= radius + 1e-9
    near[np.arange(len(v)), home] = True
    return home, near


def _blocks_to_compare(a: np.ndarray, b: np.ndarray, pivots: np.ndarray | None, radius: float):
    """Blocks (rows of a, rows of b) that hold all pairs within the radius.

    Rows of a go in order of distance from the pivot that spreads b most, BAND at a time. By the triangle inequality, for every
    pivot, a partner's distance from it is within the radius of the band's; other rows of b are left out.
    """
    if pivots is None:
        yield np.arange(len(a)), np.arange(len(b))
        return
    far_a, far_b = (np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0)) for x in (a, b))
    order = np.argsort(far_a[:, far_b.std(0).argmax()], kind="stable")
    for lo in range(0, len(a), BAND):
        rows = order[lo : lo + BAND]
        low, high = far_a[rows].min(0) - radius - 1e-7, far_a[rows].max(0) + radius + 1e-7
        others = np.flatnonzero(((far_b >= low) & (far_b <= high)).all(1))
        if len(others):
            yield rows, others


def _unit(vectors) -> np.ndarray:
    v = np.array(vectors.tolist() if hasattr(vectors, "tolist") else vectors, dtype=np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def near_duplicate_embeddings(
    df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label"
) -> DataFrame:
    """Link vectors of one label whose cosine is at least threshold (double precision; 0 < threshold < 1).

    Returns a row per row of df: id_col, n_links (other vectors linked directly; equal vectors count each),
    component_id (smallest id that links reach, itself included) and kept (it is its own component). A vector that is
    null, empty, zero or holds null or non-finite components, or whose label is null, links with nothing. Vectors of
    different lengths never link. Rows with one id count as vectors of their own. A vector that only rows with a null id have
    links with its copies alone. An empty table gives an empty result. Other columns play no part.
    """
    radius = math.sqrt(2 - 2 * threshold)
    x = F.col("_v")
    rows = df.select(
        F.col(id_col).alias("_id"), (F.col(label_col) if label_col else F.lit(0)).alias("_label"), F.col(vec_col).cast("array<double>").alias("_v")
    ).withColumn(
        "_ok",
        F.coalesce(
            F.col("_label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0),
            F.lit(False),
        ),
    )
    good = rows.where("_ok").drop("_ok")
    reps = materialize(good.groupBy("_label", "_v").agg(F.min("_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    # The largest groups of vectors of one label and length, and a sample of each: bounded, so that it fits in the driver.
    group = ["_label", F.size("_v").alias("dim")]
    largest = reps.groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > PIVOT_ROWS).orderBy(F.desc("rows"), "_label", "dim").limit(PIVOT_LABELS).collect()
    pivots = {}
    if largest:
        each = max(PIVOT_ROWS, SAMPLE // len(largest))
        kinds = df.sparkSession.createDataFrame([(r["_label"], r["dim"], r["rows"]) for r in largest], good.select("_label", F.lit(0).alias("dim"), F.lit(0).cast("bigint").alias("rows")).schema)
        some = reps.join(F.broadcast(kinds), (reps["_label"] == kinds["_label"]) & (F.size("_v") == kinds["dim"])).select(reps["_label"], "dim", "rows", "rep", "_v")
        # By hash of the id, twice as many as wanted, and those of least hash of them.
        some = some.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) * F.col("rows") <= F.lit(2.0 * each * (1 << 20)))
        place = F.row_number().over(Window.partitionBy("_label", "dim").orderBy(F.xxhash64("rep"), "rep"))
        held: dict = {}
        for r in some.withColumn("place", place).where(F.col("place") <= each).select("_label", "dim", "rows", "_v").collect():
            held.setdefault((r["_label"], r["dim"]), (r["rows"], []))[1].append(r["_v"])
        pivots = {k: _choose_pivots(_unit(v), rows, radius) for k, (rows, v) in held.items()}

    def cells(batches):
        for pdf in batches:
            for (name, dim), part in pdf.groupby([pdf["_label"], pdf["_v"].map(len)]):
                if (name, dim) in pivots:
                    home, near = _cells(_unit(part["_v"]), pivots[name, dim], radius)
                else:  # a small label
                    home, near = np.zeros(len(part), int), np.ones((len(part), 1), bool)
                i, cell = near.nonzero()
                out = part.iloc[i][["_label", "rep", "copies", "_v"]].assign(dim=dim, cell=cell, home=home[i] == cell)
                yield out[["_label", "dim", "cell", "home", "rep", "copies", "_v"]]

    label = reps.schema["_label"].dataType.simpleString()
    key_type = reps.schema["rep"].dataType.simpleString()
    placed = reps.where("rep IS NOT NULL").mapInPandas(cells, f"_label {label}, dim int, cell int, home boolean, rep {key_type}, copies bigint, _v array<double>")
    key = ["_label", "dim", "cell"]
    shape = placed.groupBy(key).agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / TILE)).cast("int").alias("h"), F.ceil(F.count("*") / TILE).cast("int").alias("m")
    )
    shaped = placed.join(shape, key)
    tile = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    asks = shaped.where("home").select(*key, F.lit(True).alias("asks"), "rep", "copies", "_v", tile(F.col("h")).alias("ht"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("mt"))
    told = shaped.select(*key, F.lit(False).alias("asks"), "rep", "copies", "_v", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("ht"), tile(F.col("m")).alias("mt"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        a, b = pdf[asks], pdf[~asks]
        none = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "n": pd.Series(dtype="int64")})
        if a.empty or b.empty:
            return none
        va, vb = _unit(a["_v"]), _unit(b["_v"])
        ra, rb, copies = a["rep"].to_numpy(), b["rep"].to_numpy(), b["copies"].to_numpy()
        i, j = [], []
        for rows_, others in _blocks_to_compare(va, vb, pivots.get((pdf["_label"].iloc[0], int(pdf["dim"].iloc[0]))), radius):
            cos = va[rows_] @ vb[others].T
            linked = cos >= threshold
            for x, y in zip(*(np.abs(cos - threshold) < 1e-12).nonzero()):
                linked[x, y] = _exact_cosine(np.array(a["_v"].iloc[rows_[x]]), np.array(b["_v"].iloc[others[y]])) >= threshold
            linked &= ra[rows_][:, None] != rb[others][None]
            x, y = linked.nonzero()
            i.append(rows_[x])
            j.append(others[y])
        i, j = (np.concatenate(x) if x else np.array([], np.int64) for x in (i, j))
        if not len(i):
            return none
        n = np.bincount(i, weights=copies[j], minlength=len(ra)).astype(np.int64)  # counts below 2 ** 53
        ids, where = np.unique(np.concatenate([ra, rb]), return_inverse=True)
        root = numpy_components(len(ids), where[: len(ra)][i], where[len(ra) :][j])
        forest = np.flatnonzero(root != np.arange(len(ids)))
        has = n > 0
        return pd.concat(
            [pd.DataFrame({"a": ra[has], "b": None, "n": n[has]}), pd.DataFrame({"a": ids[forest], "b": ids[root[forest]], "n": 0})]
        )

    found = materialize(
        asks.unionByName(told).groupBy(*key, "ht", "mt").applyInPandas(join, f"a {key_type}, b {key_type}, n bigint"), "links"
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = reps.join(counts, "rep", "left").join(components, "rep", "left").select(
        "_label", "_v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = good.join(known, ["_label", "_v"]).select("_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return out.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
