"""Prefix trie of conversations, built by halving the depth (van Emde Boas recursion).

A sequence of 2h strips is cut at half depth. The cut prefix gets a name made of the name of the place where it starts and
the content of its h strips; below each name hangs a trie of its own. So upper tries and lower forests are the same task at
half the depth, and all of them are done at once: the contents of 1, 2, 4... strips are hashed bottom-up, the names of the
cuts at half, quarter, eighth... of the depth follow top-down, and the recursion ends at strips of STRIP turns, whose
names are chained within a row. Totals are taken in each strip's tries alone and then grafted: in rounds of 1, 2, 4...
strips, what the lower tries hold is added to the nodes on the way up to the top of the upper trie.

The rounds are logarithmic in the longest conversation. A conversation is never brought to one task: turns are placed by
spans of one global order, strips hold a bounded number of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lean, materialize, unused

STRIP = 16
HEADS = 8  # turns of the other conversation at most: h is a remainder of 9
PACK_BYTES = 1 << 20


def _digest(*parts: Column) -> Column:
    """128 bits of a hash of binary parts."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def turn_places(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns in order: (conv, part, pos from 1, sym, size), and how many each part holds of a conversation: (conv, part, n).

    One global order by range, each row's place in it, and the place where each conversation starts in each range: no task
    sorts a conversation that is longer than a range.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")).cast("binary"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sym = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":")).cast("binary"), role, text)
    turns = rows.where(F.col(conv_col).isNotNull())
    turns = turns.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), sym.alias("sym"), F.octet_length(text).cast("bigint").alias("size"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("sym")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.select("conv", "sym", "size", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "placed")
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = materialize(runs.withColumn("before", F.coalesce(before, F.lit(0))), "runs")
    pos = F.col("at") - F.col("first") + F.col("before") + 1
    turns = materialize(placed.join(runs.drop("n"), ["conv", "part"]).select("conv", "part", pos.alias("pos"), "sym", "size"), "turns")
    discard(placed)
    return turns, runs.drop("first", "before")


def rebuilt_strips(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations in strips of STRIP turns: (conv, strip, syms, sizes), and their lengths: (conv, length).

    Conversation c starts with the first h turns of conversation c - c % 5 and goes on with its own turns after its first h,
    h being the CRC-32 of its number modulo 9.
    """
    turns, runs = turn_places(rows, conv_col, turn_col, role_col, text_col)
    heads = turns.where(F.col("pos") <= HEADS).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "sym", "size"))).alias("heads"))
    convs = runs.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = convs.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    lead = F.coalesce(F.slice("heads", 1, F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,sym:binary,size:bigint>>"))
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").select("conv", "n", "h", lead.alias("lead"))
    length = F.size("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = materialize(convs.withColumn("length", length), "convs")
    # A row for each part of a conversation: turns meet one row by (conv, part), so no key is hot.
    shifts = runs.join(convs.select("conv", "h", (F.size("lead") - F.col("h")).alias("shift")), "conv").drop("n")
    own = turns.join(shifts, ["conv", "part"]).where(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "sym", "size")
    taken = convs.select("conv", F.explode("lead").alias("t")).select("conv", "t.pos", "t.sym", "t.size")
    every = own.unionByName(taken).withColumn("strip", F.shiftright(F.col("pos") - 1, STRIP.bit_length() - 1))
    packed = every.groupBy("conv", "strip").agg(F.sort_array(F.collect_list(F.struct("pos", "sym", "size"))).alias("t"))
    return packed.select("conv", "strip", F.col("t.sym").alias("syms"), F.col("t.size").alias("sizes")), convs.select("conv", "length")


def name_strips(strips: DataFrame, root: bytes = bytes(16)) -> DataFrame:
    """Adds names: the name of the place where the strip starts, then one after each of its turns.

    Equal names are equal prefixes: a name is a hash of an earlier name and of the contents between.
    """
    strips = materialize(strips, "strips")
    content = _digest(F.lit(b"\x01"), F.array_join(F.transform("syms", F.hex), "").cast("binary"))
    levels = [materialize(strips.where(F.size("syms") == STRIP).select("conv", "strip", content.alias("content")), "contents")]
    most = 1 + (strips.agg(F.max("strip")).first()[0] or 0)
    for k in range(most.bit_length() - 1):  # contents of 2 ** (k + 1) strips each
        half = F.shiftright(F.col("strip"), k).bitwiseAND(1)
        both = levels[-1].groupBy("conv", F.shiftright("strip", k + 1).alias("pair")).agg(
            F.max(F.when(half == 0, F.col("content"))).alias("a"), F.max(F.when(half == 1, F.col("content"))).alias("b"))
        both = both.where("a IS NOT NULL AND b IS NOT NULL")
        levels.append(materialize(both.select("conv", F.shiftleft("pair", k + 1).alias("strip"), _digest(F.lit(b"\x02"), F.col("a"), F.col("b")).alias("content")), "contents"))
    cuts = levels[0].select("conv", "strip", F.col("content").alias("start")).where(F.lit(False))
    for k in reversed(range(len(levels))):  # cuts after odd multiples of 2 ** k strips
        upper = levels[k].where(F.shiftright("strip", k).bitwiseAND(1) == 0)
        named = upper.where("strip = 0").withColumn("start", F.lit(root)).unionByName(upper.where("strip > 0").join(cuts, ["conv", "strip"]))
        new = named.select("conv", (F.col("strip") + (1 << k)).alias("strip"), _digest(F.lit(b"\x03"), F.col("start"), F.col("content")).alias("start"))
        cuts = materialize(cuts.unionByName(new), "cuts")
    ends = cuts.select("conv", (F.col("strip") - 1).alias("strip"), F.col("start").alias("end"))
    placed = strips.join(cuts, ["conv", "strip"], "left").join(ends, ["conv", "strip"], "left").withColumn("start", F.coalesce("start", F.lit(root)))
    inner = F.when(F.size("syms") == STRIP, F.slice("syms", 1, STRIP - 1)).otherwise(F.col("syms"))
    chained = F.aggregate(inner, F.array("start"), lambda names, s: F.concat(names, F.array(_digest(F.lit(b"\x04"), F.element_at(names, -1), s))))
    chained = F.when(F.size("syms") == STRIP, F.concat(chained, F.array("end"))).otherwise(chained)  # the last turn of a full strip is where the next one starts
    named = materialize(placed.withColumn("names", chained).drop("syms", "start", "end"), "named")
    discard(strips, *levels)
    return named


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending members, joined by commas, of each name: (name, ends_sha256).

    A digest is a chain, so one task reads what a name has, but packed: the numbers are sorted and written out in
    parallel by ranges of (name, conv), a task then streams packs of PACK_BYTES through the hash and holds one of them.
    """
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, said, size = None, 0, [], 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=["name", "first", "said"])

        held = 0
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if said and (n != name or size > PACK_BYTES):
                    rows.append((name, first, ",".join(said)))
                    held, said, size = held + size, [], 0
                    if held > 4 * PACK_BYTES:
                        yield out()
                        held = 0
                if not said:
                    name, first = n, c
                said.append(str(c))
                size += len(said[-1]) + 1
        if said:
            rows.append((name, first, ",".join(said)))
        yield out()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for n, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == name:
                    state.update(b",")
                else:
                    if state:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256()
                state.update(said.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])

    ends = ends.select("name", "conv").repartitionByRange(parts, "name", "conv").sortWithinPartitions("name", "conv")
    packs = bounded_batches(ends).mapInArrow(lean(pack), "name binary, first bigint, said string")
    packs = packs.repartition("name").sortWithinPartitions("name", "first")
    return packs.mapInArrow(lean(chain), "name binary, ends_sha256 string")


def graft_totals(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """Sums of leaf and own over the subtree of each node: (name, leaves, saved).

    nodes: name, conv (the smallest member), depth, leaf (1 or 0), own. A node's smallest member walks its path, and what a
    member is the smallest of is the end of its path; so within a strip the totals are sums over suffixes of one row.
    """
    strip = F.shiftright(F.greatest(F.col("depth") - 1, F.lit(0)), STRIP.bit_length() - 1)
    owned = nodes.select("conv", strip.alias("strip"), (F.col("depth") - strip * STRIP).alias("i"), "leaf", "own")
    owned = owned.groupBy("conv", "strip").agg(F.collect_list(F.struct("i", "leaf", "own")).alias("owned"))
    alone = materialize(named.join(owned, ["conv", "strip"]).drop("sizes"), "alone")

    def below(j: Column, field: str) -> Column:
        return F.aggregate("owned", F.lit(0).cast("bigint"), lambda t, o: t + F.when(o["i"] >= j, o[field]).otherwise(0).cast("bigint"))

    each = alone.select("strip", F.explode(F.transform("names", lambda n, j: F.struct(n.alias("name"), j.alias("j"), below(j, "leaf").alias("leaves"), below(j, "own").alias("saved")))).alias("t"))
    sums = each.where("t.j > 0 OR strip = 0").select("t.name", "t.leaves", "t.saved")
    start, last = F.element_at("names", 1), named.agg(F.max("strip")).first()[0] or 0
    if last:
        starts = named.where("strip > 0").select("conv", "strip", start.alias("name"))
        zero = F.lit(0)
        tops = alone.where("strip > 0").select(start.alias("name"), "strip", "conv", below(zero, "leaf").alias("leaves"), below(zero, "own").alias("saved"))
        merged = lambda t: t.groupBy("name", "strip").agg(F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        tops, grafts = materialize(merged(tops), "tops"), []
        for k in range(last.bit_length()):  # lower tries of 2 ** k strips go onto upper ones of as many
            lower = tops.where(F.shiftright("strip", k).bitwiseAND(1) == 1).withColumn("top", F.col("strip") - (1 << k))
            grafts.append(lower.select("conv", "top", F.col("strip").alias("until"), "leaves", "saved"))
            up = lower.drop("name", "strip").withColumnRenamed("top", "strip").where("strip > 0").join(starts, ["conv", "strip"])
            kept = tops.where(F.shiftright("strip", k).bitwiseAND(1) == 0)
            tops = materialize(merged(kept.unionByName(up)), "tops")
        every = grafts[0]
        for g in grafts[1:]:
            every = every.unionByName(g)
        way = every.select("conv", F.explode(F.sequence("top", F.col("until") - 1)).alias("strip"), "leaves", "saved")
        way = way.groupBy("conv", "strip").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        met = way.join(named.select("conv", "strip", "names"), ["conv", "strip"])
        met = met.select("strip", F.posexplode("names").alias("j", "name"), "leaves", "saved").where("j > 0 OR strip = 0")
        sums = sums.unionByName(met.select("name", "leaves", "saved"))
    return sums.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def conversation_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Turns go by turn, null first; turns with the same number go by a digest of role and text, so repeated rows
    stay and any order of the input gives the same trie. A null role or text is empty. Rows without a conversation number
    belong to none and play no part. An empty table has no nodes. Extra columns play no part. Equal contents are told by
    128 bits of SHA-256.
    """
    strips, convs = rebuilt_strips(rows, conv_col, turn_col, role_col, text_col)
    root = bytes(16)
    named = name_strips(strips, root)
    steps = F.transform("sizes", lambda size, i: F.struct((F.col("strip") * STRIP + i + 1).alias("depth"), F.get("names", i).alias("parent"), F.get("names", i + 1).alias("name"), size.alias("size")))
    seen = named.select("conv", F.explode(steps).alias("s")).select("conv", "s.*")
    top = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(root).alias("name"), F.lit(0).cast("bigint").alias("size"))
    nodes = seen.unionByName(top).groupBy("name", "parent", "depth", "size").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "name")
    own = (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("own", own)
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "nodes")
    totals = graft_totals(nodes, named)
    place = F.shiftright(F.col("length") - 1, STRIP.bit_length() - 1)
    ends = convs.where("length > 0").select("conv", place.alias("strip"), (F.col("length") - place * STRIP + 1).cast("int").alias("i"))
    ends = ends.join(named.select("conv", "strip", "names"), ["conv", "strip"]).select("conv", F.element_at("names", F.col("i")).alias("name"))
    ends = ends_digest(ends.unionByName(convs.where("length = 0").select("conv", F.lit(root).alias("name"))))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(totals, "name", "left").join(ends, "name", "left").join(parents, "parent", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.greatest("leaf", F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
