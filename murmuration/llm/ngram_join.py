"""Jaccard join of documents on word n-grams: a grouped prefix join whose verified links are kept as components.

Two sets of sizes x and y that reach the similarity share a shingle among the first x - ceil(t x) + 1 of either, in
any one order of all shingles. Frequent shingles go last in that order, so that boilerplate is hardly ever in a prefix.
Which are frequent is counted over all documents but matters for speed only: any order gives the same links.

1. Each document gives its set size, a digest of its set, its prefix, and a digest of size and prefix. Documents with
   equal sets are one (exact copies); those with equal size and prefix form a group, and groups are joined.
2. Star round: of the groups that share a prefix shingle, each meets the first and its neighbour only (in
   order of the shingle's position, so the least changed copy comes first); members meet the leader of their group. Of the
   pairs that fit by size and by the positions of their shared shingle, those are verified on the whole sets whose bit
   sketches differ little enough; links join up to components.
3. Closing round: where the groups of one prefix shingle are still in several components, they are expanded to members
   and every pair of members from different components that fits likewise is verified too. A pair within one component
   would change nothing. So the components are exact, and thousands of near copies cost thousands of pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, discard, lean, materialize, text_runs

FREQUENT = 1 << 20
TASK_FREQUENT = 1 << 18
COUNT_RUN = 2_000_000
EARLIER = 8
LIST_ROWS = 16_384
FILTER_BITS = 1 << 28
SKETCH_BITS = 8
#: Bits of a shingle's hash in postings, where agreement only makes a pair worth a look.
POSTED = (1 << 48) - 1
WORD_RUN = 1 << 20


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


class _Bytes:
    """Fixed tables of word hashing: a random number for each byte (A-Z as a-z), white space, and powers of an odd number."""

    rnd = np.random.Generator(np.random.Philox(key=20))
    value = rnd.integers(0, 2**64, 256, np.uint64)
    value[65:91] = value[97:123]
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    base = 0x9E3779B97F4A7C15 | 3
    inverse = pow(base, -1, 2**64)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            make = lambda x: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))))
            if n > 2 * WORD_RUN:  # one very long text: not kept
                return make(cls.base), make(cls.inverse)
            cls.up, cls.down = make(cls.base), make(cls.inverse)
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word (run without ASCII white space, A-Z lowered) of UTF-8 bytes.

    A word's hash is its sum of byte values times powers of an odd number, from differences of running sums, then mixed.
    Bytes go in runs of about WORD_RUN that end at white space.
    """
    buf = np.frombuffer(raw, np.uint8)
    white = _Bytes.white[buf]
    starts, hashes, at = [], [], 0
    while at < len(buf):
        end = min(at + WORD_RUN, len(buf))
        while end < len(buf) and not white[end]:
            more = np.flatnonzero(white[end : end + WORD_RUN])
            end = end + int(more[0]) if len(more) else min(end + WORD_RUN, len(buf))
        w = white[at:end]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], w, [True]))))
        lo, hi = edge[::2], edge[1::2]
        up, down = _Bytes.powers(end - at)
        total = np.concatenate(([np.uint64(0)], np.cumsum(np.where(w, np.uint64(0), _Bytes.value[buf[at:end]]) * up)))
        h = (total[hi] - total[lo]) * down[lo]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        starts.append(lo + at)
        hashes.append(h ^ (h >> np.uint64(32)))
        at = end
    none = np.array([], np.uint64)
    return np.concatenate([none.astype(np.int64), *starts]), np.concatenate([none, *hashes])


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer than n words is one shingle, none is empty.

    Words are runs without ASCII white space, A-Z lowered; hashes stand for shingles (two of one pair of documents
    agree by chance about once in 10**13 documents of a thousand words).
    """
    raw = [t.encode() if t else b"" for t in texts]
    starts, h = word_hashes(b" ".join(raw))
    first = np.cumsum([0, *[len(r) + 1 for r in raw]])
    edge = np.searchsorted(starts, first)
    with np.errstate(over="ignore"):
        full = h[: max(0, len(h) - n + 1)] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, n):
            full ^= full >> np.uint64(32)
            full = full * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(full)]
        full ^= full >> np.uint64(31)
        full *= np.uint64(0xC4CEB9FE1A85EC53)
        full ^= full >> np.uint64(29)
    out = []
    for at, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
        size = end - at
        if size >= n:
            out.append(_distinct(full[at : end - n + 1]))
        elif size:
            import xxhash

            out.append(np.array([xxhash.xxh3_64_intdigest(b"%d" % size + h[at:end].tobytes())], np.uint64))
        else:
            out.append(np.array([], np.uint64))
    return out


def _frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of the most frequent shingles, FREQUENT at most, rarest first.

    Counts run over all documents; a task reports the shingles that it meets twice in a run of
    about COUNT_RUN.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n_held = Counter(), [], 0

        def fold() -> None:
            nonlocal seen, n_held
            every = np.sort(np.concatenate([np.array([], np.uint64), *held]))
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.array([], np.int64)
            h, k = every[first], np.diff(np.append(first, len(every)))
            more = k > 1
            seen.update(dict(zip(h[more].view(np.int64).tolist(), k[more].tolist())))
            if len(seen) > 2 * TASK_FREQUENT:
                seen = Counter(dict(seen.most_common(TASK_FREQUENT)))
            held.clear()
            n_held = 0

        for batch in batches:
            for _, texts in text_runs(batch):
                for s in shingle_sets(texts, n):
                    held.append(s)
                    n_held += len(s)
                if n_held > COUNT_RUN:
                    fold()
        fold()
        top = seen.most_common(TASK_FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in top], pa.int64()), pa.array([k for _, k in top], pa.int64())], names=["h", "k"])

    counted = docs.mapInArrow(lean(count), "h bigint, k bigint").groupBy("h").agg(F.sum("k").alias("k"))
    counted = materialize(counted.withColumn("size", F.floor(F.log2("k") * 64)), "counts")
    least, room = None, FREQUENT
    for r in counted.groupBy("size").count().orderBy(F.desc("size")).collect():  # at most 4096 sizes
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    top = counted.where(F.lit(False) if least is None else F.col("size") >= least).select("k", "h").toArrow()  # at most FREQUENT rows
    k, h = top.column(0).to_numpy(), top.column(1).to_numpy()
    discard(counted)
    return h[np.lexsort((h, k))].astype(np.int64).view(np.uint64)


def _needed(size, num: int, den: int):
    """Smallest overlap, and smallest partner's size, that a set of that size needs: ceil(num * size / den)."""
    return -(-num * size // den)


def _sketch(s: np.ndarray) -> bytes:
    """A bit for each shingle, by the low bits of its hash, in the next power of two above SKETCH_BITS bits a shingle."""
    bits = 1 << max(6, (SKETCH_BITS * len(s) - 1).bit_length())
    on = np.zeros(bits, np.uint8)
    on[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many shingles only one of two sets has: bits that differ, the longer sketch folded to the shorter."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    if n < m:
        x, y, n, m = y, x, m, n
    while n > m:
        n //= 2
        x = (x | x >> n) & ((1 << n) - 1)
    return (x ^ y).bit_count()


def _profiles(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray, id_type: str) -> DataFrame:
    """id, size of the set, digest of the set, digest of size and prefix, prefix, how many of its last shingles are frequent."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for ids, texts in text_runs(batch):
                sizes, whole, group, prefixes, late_ones = [], [], [], [], []
                for s in shingle_sets(texts, n):
                    sizes.append(len(s))
                    if not len(s):
                        whole.append(None), group.append(None), prefixes.append(None), late_ones.append(0)
                        continue
                    late = []
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        common = known[at] == s
                        late = np.argsort(by_hash[at[common]], kind="stable")
                        ordered = np.concatenate([s[~common], s[common][late]])
                    else:
                        ordered = s
                    prefix = ordered[: len(s) - _needed(len(s), num, den) + 1]
                    whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                    group.append(xxhash.xxh3_128_digest(b"%d:" % len(s) + prefix.tobytes()))
                    prefixes.append((prefix & np.uint64(POSTED)).view(np.int64))
                    late_ones.append(max(0, len(prefix) - (len(s) - len(late))))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(group, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(late_ones, pa.int32())],
                    names=["id", "n", "whole", "grp", "prefix", "late"],
                )

    return docs.mapInArrow(lean(run), f"id {id_type}, n bigint, whole binary, grp binary, prefix array<bigint>, late int")


def _only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose ids are among ids, and a few others: a bitmap keeps most texts out of the shuffle that follows.

    ids is a written table. The bitmap has 16 bits an id, FILTER_BITS (32 MB) at most: it is broadcast. When it is that
    full it lets more rows through, which the join that follows drops.
    """
    bits = min(FILTER_BITS, 1 << max(16, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(id_col), F.lit(bits))
    words = ids.select((bit / 64).cast("bigint").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("_bits"))
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    has = F.call_function("shiftrightunsigned", F.col("_bits"), (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return docs.withColumn("_word", (bit / 64).cast("bigint")).join(F.broadcast(words), "_word").where(has).select(*docs.columns)


def _ends(pairs: DataFrame, id_col: str) -> DataFrame:
    return pairs.select(F.col("a").alias(id_col)).union(pairs.select(F.col("b").alias(id_col)))


def _likely(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) without those whose sketches show that they can't reach the similarity; no link is lost."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_runs(batch):
                sets = shingle_sets(texts, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary())], names=["id", "n", "sketch"])

    some = _only(docs, _ends(pairs, id_col), id_col).select(id_col, text_col)
    some = materialize(some.mapInArrow(lean(sketch), f"id {kind}, n bigint, sketch binary"), "sketches")
    side = lambda k: some.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.col("na") + F.col("nb"), "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, sa, sb = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [sketch_difference(x, y) * (den + num) <= t * (den - num) for t, x, y in zip(total, sa, sb)]
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"])

    out = materialize(both.mapInArrow(lean(run), f"a {kind}, b {kind}").distinct(), "likely")
    discard(some)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (a, b) whose whole sets reach the similarity. Texts travel, which are smaller than their sets."""
    kind = docs.schema[id_col].dataType.simpleString()
    some = _only(docs, _ends(pairs, id_col), id_col)
    left = some.select(F.col(id_col).alias("a"), F.col(text_col).alias("ta"))
    right = some.select(F.col(id_col).alias("b"), F.col(text_col).alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None  # rows come in order of a
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                heads, keep = part.column(0).to_pylist(), []
                others = shingle_sets(part.column(3).to_pylist(), n)
                for head, text, other in zip(heads, part.column(2), others):
                    if known is None or head != last:
                        last, known = head, shingle_sets([text.as_py()], n)[0]
                    shared = len(known) + len(other) - len(_distinct(np.concatenate([known, other])))
                    keep.append(den * shared >= num * (len(known) + len(other) - shared))
                part = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"])

    return both.mapInArrow(lean(run), f"a {kind}, b {kind}")


def near_duplicate_documents(
    df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Link documents whose sets of n-word shingles have den * |intersection| >= num * |union|.

    Returns a row per row of df: id_col, n_shingles, component_id (smallest id that links reach, itself included).
    Words are runs of characters other than space and U+0009..U+000D, with A-Z lowered. A text of fewer than n words is
    one shingle; one that is null or has no words has none and links with nothing. Texts are taken whole. Ids must be
    distinct (rows that repeat an id are one document in links, each with its row). A row with a null id that is an exact copy
    of another goes by it; a near copy with a null id links with nothing. An empty table gives an empty result. Other columns
    play no part.
    """
    docs = bounded_batches(df.select(id_col, text_col))
    id_type = docs.schema[0].dataType.simpleString()
    frequent = _frequent_shingles(docs, n)
    profiles = materialize(_profiles(docs, n, num, den, frequent, id_type), "profiles")
    some = profiles.where("n > 0")
    distinct = some.groupBy("whole").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("grp").alias("grp"))
    groups = distinct.groupBy("grp").agg(F.min("rep").alias("g"), F.count("*").alias("members"))
    reps = materialize(distinct.join(groups, "grp").select("whole", "rep", "n", "g", "members"), "reps")
    leaders = reps.where("rep = g").select(F.col("g").alias("id"), "members")
    # A posting is three numbers in the shuffle: the shingle (with the salt mixed in), the group, and size and position.
    # Lists of frequent shingles are dealt over tasks of about LIST_ROWS groups; the leaders of those meet in a second step.
    salts = max(1, -(-reps.count() // LIST_ROWS))
    h = F.xxhash64("g")
    mixed = F.xxhash64(F.pmod(h, F.lit(salts))).bitwiseAND(F.lit(POSTED))
    often = F.col("pos") >= F.col("from")
    postings = some.select("id", "n", "prefix", "late").join(leaders, "id")
    postings = postings.select(F.posexplode("prefix").alias("pos", "token"), F.col("id").alias("g"), "n", (F.size("prefix") - F.col("late")).alias("from"))
    postings = postings.select(
        F.when(often, F.col("token").bitwiseXOR(mixed)).otherwise(F.col("token")).alias("list"), "g",
        (F.col("n") * (1 << 32) + F.col("pos") * 2 + often.cast("bigint")).alias("at"),
    ).repartition("list")  # here, as Spark would else shuffle what is unpacked for the window below

    def fits(n1, p1, n2, p2):
        """Whether sets of sizes n1, n2 can reach the similarity if their first common shingle is at these positions."""
        return (den + num) * F.least(n1 - p1, n2 - p2) >= num * (n1 + n2)

    canonical = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    one = F.struct("g", "n", "pos")

    def led(rows: DataFrame, key: str) -> DataFrame:
        """Rows with the first of their list, the one before and the one after; windows that run row by row.

        The first has the fewest rarer shingles before this one: of near copies that is the least changed.
        """
        w = Window.partitionBy(key).orderBy("pos", "h", "g")
        return rows.withColumns({"l1": F.first(one).over(w.rowsBetween(Window.unboundedPreceding, 0)), "l2": F.lag(one).over(w), "next": F.lead("g").over(w)})

    def stars(rows: DataFrame) -> DataFrame:
        star = rows.where("l2 is not null").select("g", "n", "pos", F.explode(F.array("l1", "l2")).alias("l")).where(fits(F.col("l.n"), F.col("l.pos"), F.col("n"), F.col("pos")))
        return star.select(*canonical(F.col("g"), F.col("l.g"))).distinct()

    low = F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    opened = postings.select("list", "g", F.floor(F.col("at") / (1 << 32)).alias("n"), F.floor(low / 2).cast("int").alias("pos"), (low % 2 == 1).alias("often"), h.alias("h"))
    shared = led(opened, "list").where("often or l2 is not null or next is not null").drop("next")
    shared = materialize(shared.withColumn("token", F.when(F.col("often"), F.col("list").bitwiseXOR(mixed)).otherwise(F.col("list"))).drop("list"), "postings")
    heads = led(shared.where("often and l2 is null").select("token", "g", "n", "pos", "h"), "token")
    inside = reps.where("rep <> g").select(*canonical("rep", "g"))
    pairs = materialize(stars(shared).union(stars(heads)).union(inside).distinct(), "pairs")

    def check(pairs: DataFrame) -> DataFrame:
        likely = _likely(pairs, docs, n, num, den, id_col, text_col)
        found = materialize(_verified(likely, docs, n, num, den, id_col, text_col), "links")
        discard(likely)
        return found

    links = check(pairs)
    components = connected_components(links)

    # Closing round: member level, only where a shingle still has several components.
    member = reps.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "n", "g", "members", F.coalesce("component", "rep").alias("c")
    )
    own = member.where("members > 1").select(F.xxhash64(F.lit("group"), "g").alias("token"), "g", F.lit(0).alias("pos")).distinct()
    lists = shared.select("token", "g", "pos").union(own).join(member.select("g", "rep", "n", "c"), "g")
    open_ = lists.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    # A pair need come up only at its first common shingle: rows know the ones before them, up to EARLIER.
    earlier = F.collect_list("token").over(Window.partitionBy("rep").orderBy("pos", "token").rowsBetween(-EARLIER, -1))
    rows = materialize(lists.join(open_, "token").select("token", "rep", "n", "pos", "c", earlier.alias("earlier")), "open")
    major = rows.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c")).alias("m"))
    minor = rows.join(major, "token").where("c <> m.c").select("token", F.col("rep").alias("r1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("c").alias("c1"), F.col("earlier").alias("e1"), F.col("m.c").alias("big"))
    rest = (
        minor.join(rows, "token")
        .where((F.col("c1") != F.col("c")) & ((F.col("c") == F.col("big")) | (F.col("r1") < F.col("rep"))) & fits(F.col("n1"), F.col("p1"), F.col("n"), F.col("pos")) & ~F.arrays_overlap("e1", "earlier"))
        .select(*canonical("r1", "rep"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    rest = materialize(rest, "rest")
    discard(rows, shared, pairs)
    if rest.take(1):
        components = connected_components(links.union(check(rest)))
    found = reps.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("whole", F.coalesce("component", "rep").alias("component_id"))
    # Documents without words have no digest and match nothing.
    empty = profiles.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return some.select("id", "n", "whole").join(found, "whole").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
