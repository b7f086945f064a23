"""Mixing sources to target weights by fixed-length blocks.

Each source's words, document after document, are one stream, cut into blocks of a fixed number of words. The mix is a
row of output shards of SHARD_SLOTS slots, a block each:

1. a source gives as many words as its target says, so it has a quota of slots;
2. the shards draw their source counts under these quotas: independent multinomial draws, conditioned on the sums over all
   shards, are draws without replacement. The row of shards is halved again and again, and each half draws its counts from
   those of the whole by a generator keyed by the halving, so any task draws its own shards alone;
3. slot j of a source is in epoch j // blocks and takes block pi(j % blocks), where pi is a keyed permutation of the
   indices, one per source and epoch; a keyed permutation of the shard's places says where the block stands in the shard;
4. slots and blocks meet in a join on (source, block). An epoch uses a block once, so no word is taken more than twice.

Sources are a list with a row each that every drawing task knows, MAX_SOURCES at most (more are refused); nothing else
that grows with the input leaves its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

WEIGHTS = (5, 2, 1)
BLOCK = 256
SHARD_SLOTS = 4096
MAX_SOURCES = 1_000_000
#: Beyond so many slots a half takes its part of each source to a slot, without a draw.
DRAWN_SLOTS = 900_000_000
DOCS_PER_BUCKET = 1_000
SLOTS_PER_TASK = 200_000
SHARDS_PER_TASK = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size) at the given indices: a Feistel network, walked until it is back in range."""
    if size <= 1:
        return np.zeros(len(index), np.int64)
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    open_ = np.ones(len(out), bool)
    while open_.any():
        x = out[open_]
        left, right = x >> half, x & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % 2**64)
                left, right = right, left ^ (_mix64(right + salt) & mask)
        out[open_] = (left << half) | right
        open_ = out >= np.uint64(size)
    return out.astype(np.int64)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, sid, docs, source_size, target: weights repeat over the sources by code point, null last.

    Targets sum to share of all sizes. None exceeds limit times its source's size; what is above goes to the others by
    weight until none is above. That leaves level * weight for the others, and the level follows from running sums over
    the sources in order of limit * size / weight.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    sums = sums.withColumn("sid", place)
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    sums = materialize(sums.withColumn("most", F.col("source_size") * limit), "sources")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    steps = sums.select(
        (F.col("most") / F.col("weight")).alias("ratio"),
        F.row_number().over(by_ratio).alias("k"),
        F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    ).withColumn("level", (F.lit(share * total) - F.col("filled")) / F.col("open"))
    level = steps.where("level <= ratio").orderBy("k").select("level").first()
    level = float("inf") if level is None else level[0]
    return sums.select("source", "sid", "docs", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _before(rows: DataFrame, key: str, at: str, n: str, run: int = 4096) -> DataFrame:
    """Sum of n over the rows of key before this one in order of the whole number at: adds column _before.

    Runs of places are summed first, so that no window holds more than a run or a row a run.
    """
    coarse = F.floor(F.col(at) / run)
    sums = rows.groupBy(key, coarse.alias("_run")).agg(F.sum(n).alias("_n"))
    earlier = lambda *by: Window.partitionBy(key, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_run", F.coalesce(F.sum("_n").over(earlier("_run")), F.lit(0)).alias("_far"))
    near = rows.withColumn("_run", coarse).withColumn("_near", F.coalesce(F.sum(n).over(earlier("_run", at)), F.lit(0)))
    return near.join(sums, [key, "_run"]).withColumn("_before", F.col("_near") + F.col("_far")).drop("_run", "_near", "_far")


def halved(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source a part of size slots has of counts, drawn without replacement."""
    total = int(counts.sum())
    if total < DRAWN_SLOTS:
        return rng.multivariate_hypergeometric(counts, size, method="marginals")
    exact = counts * (size / total)
    part = np.minimum(np.floor(exact).astype(np.int64), counts)
    more = np.argsort(part - exact + rng.random(len(part)) * 1e-9, kind="stable")
    for i in more[: size - int(part.sum())]:
        part[i] += part[i] < counts[i]
    for i in more:  # what rounding left over
        part[i] += min(int(counts[i] - part[i]), size - int(part.sum()))
    return part


def draw_counts(spark, sources: list, shard_slots: int, seed: int) -> DataFrame:
    """sid, words, give, shard, start, n: how many slots each output shard draws of each source, and those of the shards before it.

    sources: rows of sid, words, give, slots. A source's n sum to its slots, a shard's to shard_slots (the last one's to the rest).
    """
    sids, words, give, slots = (np.array([r[c] for r in sources], np.int64) for c in ("sid", "words", "give", "slots"))
    total = int(slots.sum())
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            low, high = int(pdf["id"].min()), int(pdf["id"].max()) + 1
            todo = [(0, shards, slots, np.zeros(len(slots), np.int64))]
            while todo:  # halves that this task has shards of, the later ones on top
                a, b, counts, start = todo.pop()
                if a >= high or b <= low:
                    continue
                if b - a == 1:
                    has = counts > 0
                    yield pd.DataFrame({"sid": sids[has], "words": words[has], "give": give[has], "shard": a, "start": start[has], "n": counts[has]})
                    continue
                middle = (a + b) // 2
                left = halved(counts, (middle - a) * shard_slots, np.random.Generator(np.random.Philox(key=[seed, a << 32 | b])))
                todo += [(a, middle, left, start), (middle, b, counts - left, start + left)]

    return spark.range(0, shards, 1, max(1, -(-shards // SHARDS_PER_TASK))).mapInPandas(draw, "sid int, words bigint, give bigint, shard bigint, start bigint, n bigint")


def mix_sources(
    df: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2, block: int = BLOCK, seed: int = 1, shard_slots: int = SHARD_SLOTS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Which words of which documents a mix of the sources takes, and where they stand in it.

    Returns a row per row of df: id_col, source, size (words of the text; null: 0), source_size, target (words that its
    source shall give), taken (words that the mix takes, repeats counted) and takes: array of (epoch, at, n, shard,
    place), the runs of n words from word number at (from 0) that an epoch takes, and the shard and its block to which
    they go. A source's taken words are its target, rounded. A null source is a source of its own, the last. Rows
    with one id, or a null id, count each. Sources without words have target 0; an empty table gives an empty result. The
    same rows and seed give the same result, whatever their order or partitions. Other columns play no part.
    """
    sized = materialize(
        df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes"
    )
    sources = materialize(source_targets(sized, weights, share, limit), "targets")
    keyed = sized.join(sources.withColumnRenamed("source", "_s"), sized["source"].eqNullSafe(F.col("_s"))).drop("_s")
    # Word offsets of documents in their source: within a bucket of some documents, plus the words of the buckets before it.
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("_id", "size"), F.ceil(F.col("docs") / DOCS_PER_BUCKET)))
    base = _before(keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "sid", "bucket", "n").select("sid", "bucket", F.col("_before").alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["sid", "bucket"])
    placed = placed.withColumn("at", F.col("before") + F.col("base")).drop("before", "base", "bucket", "docs")

    words, give = F.col("source_size"), F.least(F.round("target").cast("bigint"), F.col("source_size") * limit)
    per_epoch = F.ceil(words / block)
    slots = F.floor(F.col("give") / words) * per_epoch + F.ceil(F.col("give") % words / block)
    plan = sources.where("source_size > 0").withColumn("give", give).where("give > 0").select("sid", words.alias("words"), "give", slots.alias("slots"))
    if plan.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of them")
    known = plan.orderBy("sid").collect()  # a row a source
    total = sum(r.slots for r in known)
    counts = materialize(draw_counts(df.sparkSession, known, shard_slots, seed), "drawn")
    in_shard = Window.partitionBy("shard")
    first = F.coalesce(F.sum("n").over(in_shard.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"first": first, "all": F.sum("n").over(in_shard)})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, words, give, shard, start, n, first, all_ in pdf.itertuples(index=False):
                full, per_epoch = words // block, -(-words // block)
                for lo in range(start, start + n, 1_000_000):
                    j = np.arange(lo, min(start + n, lo + 1_000_000))
                    epoch, i = j // per_epoch, j % per_epoch
                    b = np.full(len(j), full)
                    for e in np.unique(epoch):
                        own = (epoch == e) & (i < full)
                        b[own] = permuted(i[own], full, seed * 1_000_003 + sid * 31 + int(e))
                    left = give - epoch * words - i * block  # words still to give before this slot is filled
                    take = np.minimum(np.where(i < full, block, words - full * block), left)
                    place = permuted(j - start + first, all_, seed * 7_919 + shard)
                    yield pd.DataFrame({"sid": sid, "block": b, "epoch": epoch.astype("int32"), "take": take, "shard": shard, "place": place})

    tasks = max(1, -(-total // SLOTS_PER_TASK))
    slots = counts.repartition(tasks, "sid", "shard").mapInPandas(deal, "sid int, block bigint, epoch int, take bigint, shard bigint, place bigint")

    size, at = F.col("size"), F.col("at")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))))
    lo = F.greatest(at, F.col("block") * block)
    hi = F.least(at + size, F.col("block") * block + F.col("take"))
    used = (
        pieces.hint("merge").join(slots, ["sid", "block"])  # slots grow with the words: never broadcast
        .select("sid", "at", "epoch", (lo - at).alias("from"), (hi - lo).alias("n"), "shard", "place")
        .where("n > 0")
        .groupBy("sid", "at")  # one document: those with words have places of their own
        .agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", F.col("from").alias("at"), "n", "shard", "place"))).alias("takes"))
    )
    words = placed.where("size > 0").join(used, ["sid", "at"], "left")
    none = placed.where("size = 0").withColumns({"taken": F.lit(None).cast("bigint"), "takes": F.lit(None).cast(used.schema["takes"].dataType)})
    columns = [F.col("_id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "takes"]
    return words.select(columns).unionByName(none.select(columns))


def _words_of(text_col: str, takes: str) -> Column:
    """The words of a text that takes name, joined by single spaces."""
    return F.expr(
        f"array_join(flatten(transform(array(regexp_extract_all(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w -> flatten(transform({takes}, t -> slice(w, CAST(t.at AS INT) + 1, CAST(t.n AS INT)))))), ' ')"
    )


def _matched(docs: DataFrame, mixed: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Documents that the mix takes, with _size and _takes.

    They meet by id. Rows with a null id, or an id that others have too, are told apart by source, words and order of text.
    """
    keep = [*docs.columns, "_size", "_takes"]
    mixed = materialize(mixed.select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("takes").alias("_takes")), "mix")
    alike = mixed.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1 OR _id IS NULL").select("_id")
    if not alike.take(1):
        return docs.join(mixed.where("_taken > 0"), docs[id_col] == F.col("_id")).select(keep)
    alike = materialize(alike, "alike")
    named = mixed.where("_taken > 0").join(alike, "_id", "left_anti")
    whose = lambda d: d.join(alike, d[id_col].eqNullSafe(alike["_id"]), "left_semi")
    w, k = unused(docs, "_w"), unused(docs, "_k")
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")
    other = whose(docs).withColumn(w, words)
    other = other.withColumn(k, F.row_number().over(Window.partitionBy(id_col, source_col, w).orderBy(text_col)))
    place = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.desc("_taken"), "_takes"))
    taken = mixed.join(alike.withColumnRenamed("_id", "_a"), F.col("_id").eqNullSafe(F.col("_a")), "left_semi").withColumn("_place", place).where("_taken > 0")
    same = other[id_col].eqNullSafe(taken["_id"]) & other[source_col].eqNullSafe(taken["_source"]) & (other[w] == taken["_size"]) & (other[k] == taken["_place"])
    return docs.join(named, docs[id_col] == named["_id"]).select(keep).union(other.join(taken, same).select(keep))


#: Names that the mix's own columns have beside those of documents.
OWN = ("_id", "_source", "_size", "_taken", "_takes", "_take", "_n", "_a", "_place")


def _aside(docs: DataFrame, f) -> DataFrame:
    """f of docs, whose columns named as the mix's own stand under other names meanwhile."""
    clash = [c for c in docs.columns if c.lower() in OWN]
    away = {c: unused(docs, f"_own{i}") for i, c in enumerate(clash)}
    return f(docs.withColumnsRenamed(away), lambda c: away.get(c, c)).withColumnsRenamed({v: k for k, v in away.items()})


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents as the mix takes them: a row per document and epoch, with the words taken in it, in order.

    A document taken whole in an epoch keeps its text as it is; of others the taken words are joined by single spaces.
    Documents of which nothing is taken go. Rows with a null or repeated id are told apart by source, words and order of
    text. Other columns of docs stay, whatever their names.
    """
    renamed = mixed.select(F.col(id_col).alias("_mix_id"), "source", "size", "taken", "takes")
    return _aside(docs, lambda d, name: _applied(d, renamed.withColumnRenamed("_mix_id", name(id_col)), name(id_col), name(text_col), name(source_col))).select(*docs.columns)


def _applied(docs: DataFrame, mixed: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    both = _matched(docs, mixed, id_col, text_col, source_col)
    each = both.withColumn("_taken", F.explode(F.array_distinct(F.transform("_takes", lambda t: t["epoch"]))))
    each = each.withColumn("_takes", F.expr("filter(_takes, t -> t.epoch = _taken)"))
    whole = F.aggregate("_takes", F.lit(0).cast("bigint"), lambda s, t: s + t["n"]) == F.col("_size")
    return each.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(_words_of(text_col, "_takes"))).select(*docs.columns)


def mixed_blocks(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as it is written: shard, place, source, text (the block's words, joined by single spaces), docs (their ids, in order).

    Write it with partitionBy("shard"), or repartition it by shard and sort by place.
    """
    renamed = mixed.select(F.col(id_col).alias("_mix_id"), "source", "size", "taken", "takes")
    return _aside(docs, lambda d, name: _blocks(d, renamed.withColumnRenamed("_mix_id", name(id_col)), name(id_col), name(text_col), name(source_col)))


def _blocks(docs: DataFrame, mixed: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    both = _matched(docs, mixed, id_col, text_col, source_col).withColumn("_take", F.explode("_takes"))
    piece = both.select(
        F.col("_take.shard").alias("shard"), F.col("_take.place").alias("place"), F.col(source_col).alias("source"),
        F.struct((F.col("_take.at") == 0).alias("begins"), F.col(id_col).alias("id"), _words_of(text_col, "array(_take)").alias("words")).alias("piece"),
    )
    # Of a block, the document whose words begin before it comes first, then those that begin in it, by id.
    rows = piece.groupBy("shard", "place", "source").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return rows.select("shard", "place", "source", F.array_join(F.transform("p", lambda x: x["words"]), " ").alias("text"), F.transform("p", lambda x: x["id"]).alias("docs"))
