"""A table that streams write by key: each batch replaces the buckets that it touches, and a reader sees whole versions only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.imports import KEY, merge_import
from ..plans.storage import forget, written


class VersionedTable:
    """Parquet folders of buckets of a key, and a manifest of which folder holds each bucket now.

    A version is published by renaming its manifest into place; folders are never written again, so a reader that has
    begun keeps its version. The last versions kept stay readable, older folders that no kept manifest names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, StructType], key: str = "chat", buckets: int = 64, keep: int = 3):
        self.spark, self.path, self.schemas, self.key, self.buckets, self.keep = spark, path.rstrip("/"), schemas, key, buckets, keep

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """batch, and the batch whose folder holds each bucket: {"batch": n, "buckets": {bucket: batch}}; the last version by default."""
        told = self.versions()
        if not told:
            return {"batch": -1, "buckets": {}}
        fs, where = self._fs(f"{self.path}/manifests/{told[-1] if version is None else version:020d}")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table at its last version (or another one that is kept); with buckets, these alone."""
        held = self.manifest(version)["buckets"]
        paths = [f"{self.path}/{name}/{batch}/_bucket={b}" for b, batch in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def publish(self, batch: int, tables: dict[str, DataFrame], touched: list[int]) -> None:
        """Replace the touched buckets of all tables by these rows, as one version."""
        now = self.manifest()
        for name, rows in tables.items():
            columns = [F.col(f.name).cast(f.dataType) for f in self.schemas[name].fields]
            folder = f"{self.path}/{name}/{batch}"
            rows.select(self.bucket().alias("_bucket"), *columns).write.mode("overwrite").partitionBy("_bucket").parquet(folder)
            for b in touched:  # a bucket without rows has a folder too
                fs, where = self._fs(f"{folder}/_bucket={b}")
                fs.mkdirs(where)
        held = {**now["buckets"], **{str(b): batch for b in touched}}
        fs, at = self._fs(f"{self.path}/manifests/.{batch:020d}")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"batch": batch, "buckets": held}).encode()))
        out.close()
        if not fs.rename(at, self._fs(f"{self.path}/manifests/{batch:020d}")[1]):
            raise OSError(f"version {batch} of {self.path} can't be published")
        self._clean()

    def _clean(self) -> None:
        told = self.versions()
        for old in told[: -self.keep]:
            fs, where = self._fs(f"{self.path}/manifests/{old:020d}")
            fs.delete(where, False)
        needed = {b for v in told[-self.keep :] for b in self.manifest(v)["buckets"].values()}
        for name in self.schemas:
            fs, where = self._fs(f"{self.path}/{name}")
            for s in fs.listStatus(where) if fs.exists(where) else []:
                if s.getPath().getName().isdigit() and int(s.getPath().getName()) not in needed:
                    fs.delete(s.getPath(), True)


def import_batch(table: VersionedTable, rows: DataFrame, batch: int, derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> bool:
    """Merge a batch of imported rows into the table messages, by imports.merge_import; False if it has been merged before.

    rows: KEY, message_id, text, recalled, place, and other columns of messages, which come with the first copy. Only buckets of
    the batch's chats are read and written: a recall or a message that comes late changes its own chat's rows. derived are
    tables made of the messages of these buckets, published with them.
    """
    if table.manifest()["batch"] >= batch:
        return False
    rows = written(rows, "batch")
    touched = sorted(r[0] for r in rows.select(table.bucket()).distinct().collect())  # a row a bucket
    if not touched:
        forget(rows)
        return True
    stored = table.read("messages", touched)
    more = [c for c in table.schemas["messages"].names if c not in (*KEY, "message_id", "text", "recalled", "state")]
    merged = merge_import(stored.select(*KEY, "message_id", "text", "recalled", "state"), rows.select(*KEY, "message_id", "text", "recalled", "place")).drop("change")
    if more:
        known = stored.select(*KEY, F.lit(None).cast(rows.schema["place"].dataType).alias("place"), *more)
        first = known.unionByName(rows.select(*KEY, "place", *more)).groupBy(*KEY).agg(F.min(F.struct(F.col("place").isNotNull().alias("fresh"), "place", *more)).alias("first"))
        merged = merged.join(first.select(*KEY, *[F.col(f"first.{c}").alias(c) for c in more]), KEY)
    merged = written(merged, "merged")
    table.publish(batch, {"messages": merged, **{name: make(merged) for name, make in (derived or {}).items()}}, touched)
    forget(rows, merged)
    return True


def start_import(msg: DataFrame, table: VersionedTable, checkpoint: str, derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
    """Keep the table up to date with a stream of imported rows; a batch that comes again after a failure changes nothing."""
    query = msg.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.foreachBatch(lambda rows, batch: import_batch(table, rows, batch, derived) and None).start()


def fold_batch(table: VersionedTable, name: str, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
    """Replace the touched buckets of a table by merge(their rows now, the batch's rows); False if the batch has been merged before."""
    if table.manifest()["batch"] >= batch:
        return False
    rows = written(rows, "batch")
    touched = sorted(r[0] for r in rows.select(table.bucket()).distinct().collect())  # a row a bucket
    if touched:
        table.publish(batch, {name: merge(table.read(name, touched), rows)}, touched)
    forget(rows)
    return True


def start_fold(msg: DataFrame, table: VersionedTable, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """Keep a table up to date with a stream by fold_batch."""
    query = msg.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.foreachBatch(lambda rows, batch: fold_batch(table, name, rows, batch, merge) and None).start()
