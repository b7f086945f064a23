"""Streaming queries: messages arrive as files, a file a batch, a fold keeps its state, and what it has told is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .params import Params
from .plans.storage import drop, forget, fresh_path, written
from .plans.views import view
from .queries import _BURST
from .registry import query
from .streaming import live, table

FILES = 6
P = Params()


def _arriving(spark, sf, name: str | DataFrame = "v_event", *columns: str, files: int = FILES):
    """A stream of the messages, files of one stretch of time each, in no order within, then a mark that time has gone on.

    The mark is a row of no chat (chat -1), after which all is told. Rows are made once, in parallel, and dealt by stretch; only the copy
    of a stretch into its one file is one task.
    """
    rows = view(spark, sf, name).withColumn("recalled", F.col("event_type") == "error") if isinstance(name, str) else name
    rows = rows.withColumn("ts", F.timestamp_millis("ms"))
    rows = rows.select("chat", "ms", "ts", "recalled", *columns)
    rows = written(rows, "messages")
    low, high = rows.agg(F.min("ms"), F.max("ms")).first()
    path = fresh_path(spark, "arriving")
    stretch = F.least(F.floor((F.col("ms") - low) * files / (high - low + 1)), F.lit(files - 1))
    dealt = fresh_path(spark, "stretches")
    rows.withColumn("stretch", stretch.cast("int")).write.partitionBy("stretch").parquet(dealt)
    for i in range(files):
        spark.read.schema(f"{rows.schema.toDDL()}, stretch int").parquet(dealt).where(F.col("stretch") == i).drop("stretch").coalesce(1).write.mode("append").parquet(path)
    drop(spark, dealt)
    forget(rows)
    end = high + 30 * 86_400_000
    mark = spark.range(1).select(F.lit(-1).cast(rows.schema["chat"].dataType).alias("chat"), F.lit(end).cast("bigint").alias("ms"), F.timestamp_millis(F.lit(end)).alias("ts"))
    mark = mark.select("chat", "ms", "ts", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("recalled", *columns)])
    mark.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT chat, ms // 600000 * 600000 AS slot_ms, count(*) AS messages, min(event_id) AS first_id FROM v_event GROUP BY ALL")
def stream_buckets(spark, sf):
    return live.caught_up(spark, live.buckets(_arriving(spark, sf, "v_event", "event_id")), "buckets").where("chat >= 0")


@query("""WITH s AS (SELECT *, sum(o) OVER (PARTITION BY chat ORDER BY pos) AS session FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY chat ORDER BY pos) < 1800000 THEN 0 ELSE 1 END AS o FROM v_event))
    SELECT chat, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS messages FROM s GROUP BY chat, session""")
def stream_sessions(spark, sf):
    return live.caught_up(spark, live.sessions(_arriving(spark, sf)), "sessions").where("chat >= 0")


def _imported(spark, sf, derived=None, schemas=None):
    """The table after an import of all files; three copies of a message each, some of them recalled."""
    rows = _arriving(spark, sf, "v_event", "event_id").where("chat >= 0")
    n = F.floor(F.col("event_id") / 3).cast("string")
    rows = rows.select("chat", F.concat(F.lit("qce:"), n).alias("source_identity"), F.concat(F.lit("m"), n).alias("message_id"), F.concat(F.lit("said "), n).alias("text"), "recalled", F.col("event_id").alias("place"))
    kind = rows.schema["chat"].dataType.simpleString()
    messages = StructType.fromDDL(f"chat {kind}, source_identity string, message_id string, text string, recalled boolean, state string")
    held = table.VersionedTable(spark, fresh_path(spark, "imported"), {"messages": messages, **{k: StructType.fromDDL(v.format(kind)) for k, v in (schemas or {}).items()}}, buckets=16)
    table.start_import(rows, held, fresh_path(spark, "imported-state"), derived).awaitTermination()
    return held


@query("SELECT chat, 'qce:' || event_id // 3 AS source_identity, count(*) AS copies, bool_or(event_type = 'error') AS recalled FROM v_event GROUP BY ALL")
def stream_import(spark, sf):
    """Copies are counted in the table itself, so that the stream keeps no state."""
    rows = _arriving(spark, sf, "v_event", "event_id").where("chat >= 0")
    rows = rows.select("chat", F.concat(F.lit("qce:"), F.floor(F.col("event_id") / 3).cast("string")).alias("source_identity"), "recalled")
    kind = rows.schema["chat"].dataType.simpleString()
    schema = StructType.fromDDL(f"chat {kind}, source_identity string, copies long, recalled boolean")
    held = table.VersionedTable(spark, fresh_path(spark, "copies"), {"messages": schema}, buckets=16)

    def added(old, new):
        both = old.unionByName(new.select("chat", "source_identity", F.lit(1).cast("bigint").alias("copies"), "recalled"))
        return both.groupBy("chat", "source_identity").agg(F.sum("copies").alias("copies"), F.bool_or("recalled").alias("recalled"))

    table.start_fold(rows, held, "messages", added, fresh_path(spark, "copies-state")).awaitTermination()
    return held.read("messages")


@query("""SELECT chat, 'qce:' || event_id // 3 AS source_identity, 'm' || event_id // 3 AS message_id, CASE WHEN bool_or(event_type = 'error') THEN '' ELSE 'said ' || event_id // 3 END AS text,
    bool_or(event_type = 'error') AS recalled, CASE WHEN bool_or(event_type = 'error') THEN 'skipped' ELSE 'pending' END AS state FROM v_event GROUP BY chat, event_id // 3""")
def stream_import_table(spark, sf):
    """Messages after a stream of imports: first copies stay, recalls are for good, only touched chats are rewritten."""
    return _imported(spark, sf).read("messages")


@query("""WITH m AS (SELECT chat, event_id // 3 AS k, bool_or(event_type = 'error') AS recalled FROM v_event GROUP BY ALL)
    SELECT chat, count(*) AS messages, count(*) FILTER (recalled) AS recalled, sum(CASE WHEN recalled THEN 0 ELSE len('said ' || k) END)::BIGINT AS chars FROM m GROUP BY chat""")
def stream_import_derived(spark, sf):
    """A table made of the messages of a chat, computed anew for the chats that a batch touches."""
    made = lambda m: m.groupBy("chat").agg(F.count("*").alias("messages"), F.count_if("recalled").alias("recalled"), F.sum(F.length("text")).alias("chars"))
    return _imported(spark, sf, {"chats": made}, {"chats": "chat {}, messages long, recalled long, chars long"}).read("chats")


@query("""WITH t AS (SELECT chat, event_id // 500 AS topic, ms FROM v_event), o AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 21600000 THEN 0 ELSE 1 END AS o FROM t WINDOW w AS (PARTITION BY chat, topic ORDER BY ms)),
    s AS (SELECT *, sum(o) OVER (PARTITION BY chat, topic ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT chat, topic, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS messages FROM s GROUP BY chat, topic, run""")
def stream_topic_runs(spark, sf):
    rows = _arriving(spark, sf, "v_event", "event_id").withColumns({"topic": F.floor(F.col("event_id") / 500), "ordinal": F.col("event_id")})
    return live.caught_up(spark, live.topic_runs(rows, P.topic_ttl_ms), "runs").where("chat >= 0")


@query(_BURST + " SELECT b.chat, b.message_id, f.message_id AS burst FROM b JOIN v_msg f ON f.chat = b.chat AND f.pos = b.start")
def stream_bursts(spark, sf):
    msg = view(spark, sf, "v_msg")
    target = msg.select("chat", F.col("pos").alias("reply_pos"), F.col("message_id").alias("reply_to"))
    rows = _arriving(spark, sf, msg.join(target, ["chat", "reply_pos"], "left"), "ordinal", "message_id", "sender", "reply_to")
    return live.caught_up(spark, live.bursts(rows, P), "bursts").where("chat >= 0")


@query("""WITH k AS (SELECT chat, event_id, (ms // 3600000 + unnest(range(1, 25))) * 3600000 AS until_ms FROM v_event)
    SELECT chat, until_ms, count(*) AS messages, max(event_id) AS last_id FROM k GROUP BY chat, until_ms""")
def stream_trailing(spark, sf):
    return live.caught_up(spark, live.trailing(_arriving(spark, sf, "v_event", "event_id")), "trailing").where("chat >= 0")
