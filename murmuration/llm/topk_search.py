"""Exact top-k search: tiles of queries and shards, selection in each tile, and a tree of merges.

Queries and candidates are dealt by hash into blocks of bounded size. A task multiplies one block of queries with one
shard of candidates and keeps the k best of each query there; further rounds merge those lists, FAN of them at a time,
until one list per query is left. No side is broadcast, and a query's lists never meet in one task unmerged.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
SHARD = 16_384
TILE_QUERIES = 256  # products are made for so many queries at once
FAN = 64


def _whole(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component: doubles where these are exact, else Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(v * scale)
    if np.abs(out).max(initial=0) < 2**53:
        return out
    return np.array([[math.floor(Fraction(float(x)) * Fraction(scale)) for x in r] for r in v], object).reshape(v.shape)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these are exact, else in Python's integers, held to a long."""
    if q.dtype != object and c.dtype != object and float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
    return np.clip(exact(q) @ exact(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def top_k_inner_product(
    df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The k candidates of highest score for each query: query_id, rank (from 1), vec_id, score.

    Components x become floor(scale * x). Queries are the rows whose id is divisible by every, candidates all rows but
    those with the query's own id; a score is the integer inner product, ties go to the smaller id. Fewer candidates
    than k give as many rows. Vectors that are null, empty or hold null or non-finite components take no part, nor do
    rows without an id; vectors of different lengths are not compared. Repeated rows are candidates of their own;
    of query rows with one id, the one with the smallest vector in order of components asks.
    Scores beyond a long are held at its ends. Other columns play no part.
    """
    x = F.col("_v")
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(
        F.col("_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("_id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERY_BLOCK))
    dealt = lambda parts: F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asking = rows.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    queries = asking.select(F.lit(True).alias("asks"), "_id", "_v", dealt(blocks).alias("qb"), upto(shards).alias("shard"))
    told = rows.select(F.lit(False).alias("asks"), "_id", "_v", upto(blocks).alias("qb"), dealt(shards).alias("shard"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        shard = pdf["shard"].iloc[0]
        for _, same in pdf.groupby(pdf["_v"].map(len)):
            asks = same["asks"].to_numpy(bool)
            if not asks.any():
                continue
            whole = _whole(np.array(same["_v"].tolist(), np.float64), scale)
            ids = same["_id"].to_numpy(np.int64)
            qid, order = ids[asks], np.argsort(ids[~asks], kind="stable")
            cid = ids[~asks][order]
            asked, told_ = whole[asks], whole[~asks][order]
            scores = (row for lo in range(0, len(asked), TILE_QUERIES) for row in _scores(asked[lo : lo + TILE_QUERIES], told_))
            for q, row in zip(qid, scores):
                own = cid != q
                row, cand = row[own], cid[own]
                if len(row) > k:  # all that reach the k-th score, so that ties stay in
                    best = np.flatnonzero(row >= np.partition(row, -k)[-k])
                    row, cand = row[best], cand[best]
                best = np.lexsort((cand, -row) if row.min(initial=0) > -(2**63) else (cand, np.array([-int(v) for v in row], object)))[:k]
                out.append((np.full(len(best), q), cand[best], row[best]))
        q, c, s = (np.concatenate([o[i] for o in out]) if out else np.array([], np.int64) for i in range(3))
        return pd.DataFrame({"query_id": q, "shard": np.full(len(q), shard), "vec_id": c, "score": s})

    lists = queries.unionByName(told).groupBy("qb", "shard").applyInPandas(tile, "query_id bigint, shard int, vec_id bigint, score bigint")
    while True:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", (F.col("shard") / FAN).cast("int"))
        place = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id"))
        lists = lists.withColumn("rank", place).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
