"""Where jobs put intermediate results that must survive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a temporary one only where that is unset on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="murmuration-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends, or by drop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
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


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and forget() deletes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    for t in tables:
        drop(t.sparkSession, t.written_path)
