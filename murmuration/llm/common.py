"""Shared pieces of the training-data operators: durable intermediates, components, column checks."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_left: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="murmuration-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends, or by drop()."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _left[:] = [x for x in _left if x[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_left):
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone already; nothing else depends on this
            return


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Shuffle files of a finished write are removed at once instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrow batches by bytes, so that rows with long texts come few at a time, on both sides of the pipe.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df itself; its session exchanges Arrow batches of BATCH_BYTES at most (or one row) with Python workers."""
    df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that ran there, and readers prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing will read again."""
    for t in tables:
        drop(t.sparkSession, t.scratch_path)


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(run):
    """A function for mapInArrow or mapInPandas that gives freed memory back when a partition ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every linked node with the smallest id that links reach from it: (node, component).

    Alternating large-star and small-star steps until nothing changes. Each step takes minima per node (combined
    before the shuffle) and joins them back, so no neighbour list is ever gathered. Nodes without links are absent.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, before = materialize(e, "edges"), None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        stars = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        less = stars.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = materialize(less.union(low).distinct(), "edges"), e
        discard(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v"), F.col("v")).distinct()
            )
        before = now


def text_runs(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """A batch in runs of rows with a bounded total of text (or one longer row)."""
    ids, texts, start, held = batch.column(0), batch.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > chars:
            yield ids.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield ids.slice(start), texts[start:]


def numpy_components(n: int, a, b):
    """Smallest index reachable from each of n nodes over the edges a[i] - b[i]; O(log n) vector rounds."""
    import numpy as np

    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            return root
