"""Streams: the same folds as in batch, kept up to date as files of messages arrive.

Windowed folds run in append mode: a span's row comes once the watermark has passed it, and its state goes. What the built-in
windows can't say (bursts, closes strictly after a silence) are processors with their own state and event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import Params
from ..plans.storage import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def buckets(msg: DataFrame, span: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """chat, slot_ms, messages, first_id: tumbling spans, each told once; a row that comes later than late is left out."""
    w = F.window("ts", span)
    each = msg.withWatermark("ts", late).groupBy("chat", w.alias("w")).agg(F.count("*").alias("messages"), F.min("event_id").alias("first_id"))
    return each.select("chat", F.unix_millis("w.start").alias("slot_ms"), "messages", "first_id")


def sessions(msg: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """chat, start_ms, last_ms, messages: runs of messages less than gap apart."""
    each = msg.withWatermark("ts", late).groupBy("chat", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("messages"), F.max("ms").alias("last_ms"))
    return each.select("chat", F.unix_millis("w.start").alias("start_ms"), "last_ms", "messages")


def trailing(msg: DataFrame, span: str = "24 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """chat, until_ms, messages, last_id: what a report over the last span would count, every step."""
    each = msg.withWatermark("ts", late).groupBy("chat", F.window("ts", span, step).alias("w")).agg(F.count("*").alias("messages"), F.max("event_id").alias("last_id"))
    return each.select("chat", F.unix_millis("w.end").alias("until_ms"), "messages", "last_id")


class InOrder(StatefulProcessor):
    """Rows of a key in order of time (ms, then ordinal), whatever order they arrive in within the watermark's delay.

    A row waits until the watermark has passed it. Spark leaves out rows that come later than that, and counts them
    (numRowsDroppedByWatermark). State is the rows that wait and what step() keeps.
    """

    waits: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.schema = pa.schema([(name, {"LONG": pa.int64(), "STRING": pa.string()}[kind]) for name, kind in (f.split() for f in self.waits.split(", "))])
        self.begin()

    def _packed(self, rows: pa.Table) -> tuple[bytes]:
        """Rows as one entry of the state: an entry a row would cost far more than the fold."""
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema) as to:
            to.write_table(rows)
        return (out.getvalue().to_pybytes(),)

    def _held(self) -> pa.Table:
        return pa.concat_tables([self.schema.empty_table(), *(pa.ipc.open_stream(bytes(r[0])).read_all() for r in (self.waiting.get() if self.waiting.exists() else ()))])

    def begin(self) -> None: ...

    def step(self, key, rows: list[tuple], now: int) -> list[tuple]:
        """Fold rows in order; now is the watermark. Returns rows of the result."""
        raise NotImplementedError

    def next_timer(self) -> int | None:
        """When to look again though nothing waits, in ms."""
        return None

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False) for pdf in rows if len(pdf)]
        if fresh:
            self.waiting.appendList([self._packed(t) for t in fresh])
            self.handle.registerTimer(min(pc.min(t["ms"]).as_py() for t in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        due = pc.less_equal(held["ms"], now)
        ready, rest = held.filter(due).sort_by([(c, "ascending") for c in self.schema.names[:2]]), held.filter(pc.invert(due))
        out = self.step(key, list(zip(*(c.to_pylist() for c in ready.columns))), now)
        if len(ready):
            self.waiting.clear()
            if len(rest):
                self.waiting.put([self._packed(rest)])
        more = [pc.min(rest["ms"]).as_py()] if len(rest) else []
        more += [t for t in [self.next_timer()] if t is not None]
        if more:
            self.handle.registerTimer(int(max(now + 1, min(more))))
        if out:
            yield self._frame(out)

    def close(self) -> None: ...


class Bursts(InOrder):
    """Bursts by the rules of operators.segment.bursts; state is the burst at the end, burst_max messages at most."""

    waits = "ms LONG, ordinal LONG, message_id STRING, sender STRING, reply_to STRING"
    columns = ["chat", "message_id", "burst"]

    def __init__(self, p: Params):
        self.p = p

    def begin(self) -> None:
        self.current = self.handle.getListState("current", "ms LONG, message_id STRING, sender STRING")

    def step(self, key, rows, now):
        if not rows:
            return []
        p, out = self.p, []
        burst = [tuple(r) for r in self.current.get()] if self.current.exists() else []
        for ms, _, message, sender, reply in rows:
            gap = ms - burst[-1][0] if burst else 0
            joins = burst and len(burst) < p.burst_max and gap < p.strong_gap_ms
            joins = joins and (gap < p.weak_gap_ms or reply in {b[1] for b in burst} or sender == burst[-1][2] and gap <= p.same_sender_ms)
            burst = [*burst, (ms, message, sender)] if joins else [(ms, message, sender)]
            out.append((key[0], message, burst[0][1]))
        self.current.put(burst)
        return out


class TopicRuns(InOrder):
    """Runs of a topic, closed by a silence longer than ttl (not by one just as long); the state of a closed run goes."""

    waits = "ms LONG, ordinal LONG"
    columns = ["chat", "topic", "first_ms", "last_ms", "messages"]

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def begin(self) -> None:
        self.run = self.handle.getValueState("run", "first LONG, last LONG, n LONG")

    def step(self, key, rows, now):
        run, out = tuple(self.run.get()) if self.run.exists() else None, []
        for ms, _ in rows:
            if run and ms - run[1] > self.ttl:
                out.append((*key, *run))
                run = None
            run = (run[0], ms, run[2] + 1) if run else (ms, ms, 1)
        if run and now - run[1] > self.ttl:  # all that could still come is later
            out.append((*key, *run))
            run = None
        if run:
            self.run.update(run)
        elif self.run.exists():
            self.run.clear()
        return out

    def next_timer(self):
        return self.run.get()[1] + self.ttl + 1 if self.run.exists() else None


def bursts(msg: DataFrame, p: Params, late: str = "1 hour") -> DataFrame:
    """chat, message_id, burst (id of its first message): told once all up to the message has arrived.

    msg: chat, ts, ms, ordinal, message_id, sender, reply_to (id). A message that comes later than late has no burst. A chat is
    one key: its messages are read in order.
    """
    kind = msg.schema["chat"].dataType.simpleString()
    rows = msg.withWatermark("ts", late).groupBy("chat")
    return rows.transformWithStateInPandas(Bursts(p), f"chat {kind}, message_id string, burst string", "Append", "EventTime")


def topic_runs(msg: DataFrame, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """chat, topic, first_ms, last_ms, messages: runs of a topic, each told when it is closed; msg: chat, topic, ts, ms, ordinal."""
    kind, name = (msg.schema[c].dataType.simpleString() for c in ("chat", "topic"))
    rows = msg.withWatermark("ts", late).groupBy("chat", "topic")
    return rows.transformWithStateInPandas(TopicRuns(ttl_ms), f"chat {kind}, topic {name}, first_ms long, last_ms long, messages long", "Append", "EventTime")


def start(folded: DataFrame, out: str, checkpoint: str):
    """Start a fold in append mode on all that has arrived; each row goes once to the Parquet table at out, and a restart goes on from the checkpoint."""
    spark = folded.sparkSession
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return folded.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, was)


def caught_up(spark: SparkSession, folded: DataFrame, name: str) -> DataFrame:
    """Run a fold over all that has arrived, and read what it has told."""
    out = fresh_path(spark, name)
    start(folded, out, fresh_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(folded.schema).parquet(out)
