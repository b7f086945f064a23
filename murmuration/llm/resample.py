"""Importance resampling towards a target corpus: hashed word features, Gumbel keys, ranks by a distributed radix sort.

Counts of features by bucket are arrays of numpy in each task, summed over tasks by bucket; the gains of all buckets are
one array of fixed size, with which each task scores its own documents. The order of the scored documents comes from a
least-significant-digit radix sort: each pass counts the digits of each chunk of the present order, turns the counts into
the place where the chunk's rows with that digit start, and gives each row its new place. A pass deals rows by (chunk,
digit), so no key, however frequent, brings more rows to a task than a chunk has.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lean, materialize, text_runs, unused

DIGIT_BITS = 11
CHUNK_BITS = 12  # rows of a chunk: 2 ** 12 at most
WORD_BYTES = 64  # longer words aren't kept in the memo
MEMO_WORDS = 400_000

#: A-Z become a-z; of the other ASCII characters only 0-9 and a-z stay, the rest parts words.
_LETTERS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


class Buckets(dict):
    """Bucket of a word (or run of words): CRC-32 of its bytes modulo their number. A full memo starts anew; results don't change."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % self.n
        if len(word) <= WORD_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = bucket
        return bucket

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """Buckets of all runs of 1 to longest words, repeats counted."""
        out = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for k in range(2, longest + 1):
            runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            out.append(np.fromiter(map(self.__getitem__, runs), np.int64, len(runs)))
        return np.concatenate(out)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 1) -> list[int]:
    """How many features of all texts fall in each bucket: one array a task, sums over tasks by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for _, texts in (piece for batch in batches for piece in text_runs(batch)):
            for text in texts:
                total += np.bincount(bucket.of(words_of(text), longest), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = bounded_batches(df.select(F.lit(0).alias("k"), F.col(text_col).alias("text"))).mapInArrow(lean(run), "bucket bigint, n bigint")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[r.bucket] = r.n
    return out


def gains_of(here: list[int], target: list[int]) -> list[int]:
    """Thousandths of the smoothed log ratio of each bucket's share in the target to its share here, floored."""
    n, s, t = len(here), float(sum(here)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(here, target)]


def gumbel(seed: int, key: str) -> int:
    """Thousandths of a Gumbel variate drawn from a digest, floored."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(df: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", seed: int = 2024, longest: int = 1) -> DataFrame:
    """id_col, n_words, n_features, weight (floored mean gain of the features, 0 without any) and score of every row."""
    table, buckets = np.array(gains, np.int64), len(gains)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(buckets)
        for keys, texts in (piece for batch in batches for piece in text_runs(batch)):
            out = []
            for key, text in zip(keys.to_pylist(), texts):
                words = words_of(text)
                found = bucket.of(words, longest)
                weight = int(table[found].sum()) // len(found) if len(found) else 0
                out.append((len(words), len(found), weight, weight + gumbel(seed, "" if key is None else str(key))))
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([keys, *cols], names=[id_col, "n_words", "n_features", "weight", "score"])

    rows = bounded_batches(df.select(id_col, text_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _digits(key: Column, low: int, high: int) -> list[Column]:
    """Digits of an integer column between two bounds, the least significant first; none for equal bounds."""
    if high - low < 1 << 63:
        key, bits = key - F.lit(low), (high - low).bit_length()
    else:  # differences overflow: flip the sign, so that the order is that of unsigned numbers
        key, bits = key.bitwiseXOR(F.lit(-(1 << 63))), 64
    return [F.shiftrightunsigned(key, s).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int") for s in range(0, bits, DIGIT_BITS)]


def radix_ranks(rows: DataFrame, keys: list[Column], rank: str = "rank") -> DataFrame:
    """Rows with their rank (from 1) by integer keys, all ascending, nulls last: a stable radix sort, least significant digit first.

    Each pass reads the written result of the one before, so a lost executor costs the tasks that ran there. Chunks of the
    present order have a bounded number of rows; starting places are sums over (digit, chunk), a few numbers for each chunk.
    Rows equal in all keys follow each other in any order. An empty table gives an empty result.
    """
    at, digit, start, within, chunk = (unused(rows, x) for x in ("_at", "_digit", "_start", "_within", "_chunk"))
    named = [unused(rows, f"_key{i}") for i in range(len(keys))]
    held = materialize(rows.withColumns(dict(zip(named, keys))).withColumn(at, F.monotonically_increasing_id()), "radix")
    bounds = held.agg(*[f(k).alias(f"{n}{k}") for k in named for n, f in (("l", F.min), ("h", F.max))], *[F.count_if(F.col(k).isNull()).alias(f"n{k}") for k in named]).first()
    passes: list[Column] = []
    for k in reversed(named):
        low, high = bounds[f"l{k}"], bounds[f"h{k}"]
        passes += [F.coalesce(d, F.lit(0)) for d in (_digits(F.col(k), low, high) if low is not None else [])]
        passes += [F.col(k).isNull().cast("int")] if bounds[f"n{k}"] else []
    if not passes:
        passes = [F.lit(0)]
    for d in passes:
        now = held.withColumn(digit, d).withColumn(chunk, F.shiftright(at, CHUNK_BITS))
        counts = materialize(now.groupBy(digit, chunk).agg(F.count("*").alias("n")), "radix-counts")
        totals = sorted((r[0], r[1]) for r in counts.groupBy(digit).agg(F.sum("n")).collect())  # a row a digit: 2 ** DIGIT_BITS at most
        base, before = [], 0
        for value, n in totals:
            base.append((value, before))
            before += n
        first = F.broadcast(rows.sparkSession.createDataFrame(base, f"`{digit}` int, _before bigint"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy(digit).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = counts.withColumn("n", earlier).join(first, digit).select(digit, chunk, (F.col("n") + F.col("_before")).alias(start))
        ranked = now.withColumn(within, F.row_number().over(Window.partitionBy(chunk, digit).orderBy(at)))
        moved = ranked.join(places, [chunk, digit]).withColumn(at, F.col(start) + F.col(within) - 1).drop(digit, chunk, start, within)
        moved, old = materialize(moved.select(held.columns), "radix"), held
        discard(old, counts)
        held = moved
    return held.withColumn(rank, F.col(at) + 1).drop(at, *named)


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = 10_000, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draw documents whose features look like the target's: id_col, n_features, weight, score and rank of every row.

    Of the N documents with least_words words at least, floor(percent * N / 100) with the highest scores are drawn (rank 1, 2,
    3...; of equal scores the smaller id, a null id last); rank is null for all others. Words are runs of a-z, 0-9 and
    characters beyond ASCII, A-Z lower-cased. A null text has no words, a null id counts as the empty text in the draw,
    repeated rows are drawn each for itself. An empty target or table of documents gives counts of 0. Other columns play no
    part.
    """
    here = bucket_counts(documents, text_col, buckets, longest)
    gains = gains_of(here, bucket_counts(target, text_col, buckets, longest))
    scored = materialize(score_documents(documents, gains, id_col, text_col, seed, longest), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    ranked = radix_ranks(fit, [F.bitwise_not("score"), F.col(id_col).cast("long")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return every.select(id_col, "n_features", "weight", "score", "rank")
