"""Streams over several batches with a restart in between, late rows and bounded state, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmuration.params import Params
from murmuration.streaming import live, table

P = Params(weak_gap_ms=3_000, strong_gap_ms=20_000, same_sender_ms=6_000, burst_max=5, topic_ttl_ms=10_000)
SCHEMA = "chat long, ms long, ts timestamp, ordinal long, message_id string, sender string, reply_to string, topic string"


@pytest.fixture()
def arrive(spark, tmp_path):
    """Adds a file of rows to a stream's folder; stream() reads it, a file a batch."""
    schema = StructType.fromDDL(SCHEMA)

    def add(rows):
        df = spark.createDataFrame([(c, ms, None, o, f"m{c}_{o}", s, r, t) for c, ms, o, s, r, t in rows], schema).withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return add, stream, tmp_path


def told(spark, query, path):
    query.awaitTermination()
    return spark.read.parquet(str(path)).collect(), query


def dropped(query):
    return sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)


def plain_bursts(rows):
    out, held = {}, {}
    for c, ms, o, s, r, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        b = held.get(c, [])
        gap = ms - b[-1][0] if b else 0
        joins = b and len(b) < P.burst_max and gap < P.strong_gap_ms and (gap < P.weak_gap_ms or r in [x[1] for x in b] or s == b[-1][2] and gap <= P.same_sender_ms)
        held[c] = b = [*b, (ms, f"m{c}_{o}", s)] if joins else [(ms, f"m{c}_{o}", s)]
        out[f"m{c}_{o}"] = b[0][1]
    return out


def test_bursts_as_a_stream(spark, arrive):
    add, stream, path = arrive
    rnd, rows, ms = random.Random(1), [], 1_000_000
    for o in range(240):
        ms += rnd.choice([10, 2_000, 3_000, 5_000, 7_000, 20_000])
        rows.append((o % 2, ms, o, rnd.choice("ab"), f"m{o % 2}_{max(0, o - rnd.choice([2, 4, 10]))}" if rnd.random() < 0.4 else None, "t"))
    # Six files; neighbours in time are exchanged between them within the delay, order within a file is lost.
    files = [rows[i * 40 : (i + 1) * 40] for i in range(6)]
    for a, b in zip(files, files[1:]):
        a[-1], b[0] = b[0], a[-1]
    for f in files[:4]:
        add(rnd.sample(f, len(f)))
    late = "2 minutes"
    run = lambda: live.start(live.bursts(stream(), P, late), str(path / "out"), str(path / "state"))
    before, query = told(spark, run(), path / "out")
    assert len(query.recentProgress) >= 4 and 0 < len(before) < 160
    tardy = (0, rows[0][1] + 1, 9_000, "a", None, "t")
    for f in [*files[4:], [tardy], [(7, ms + 10_000_000, 9_999, "z", None, "t")]]:
        add(rnd.sample(f, len(f)))
    after, query = told(spark, run(), path / "out")  # from the checkpoint
    assert {r.message_id: r.burst for r in after} == plain_bursts(rows) and len(after) == 240
    assert dropped(query) == 1
    # What is left: the mark that waits, and a burst a chat of burst_max messages at most.
    state = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert state <= 1 + 2 * P.burst_max + 10


def test_topic_runs_close_strictly_after_the_ttl(spark, arrive):
    add, stream, path = arrive
    rnd, rows = random.Random(2), [(1, 1_000, 0, "a", None, "x"), (1, 11_000, 1, "a", None, "x"), (1, 21_001, 2, "a", None, "x")]
    ms = 30_000
    for o in range(3, 150):
        ms += rnd.choice([100, 3_000, 9_000])
        rows.append((o % 3, ms, o, "a", None, f"t{o // 20}"))
    for i in range(5):
        add(rnd.sample(rows[i * 30 : (i + 1) * 30], len(rows[i * 30 : (i + 1) * 30])))
    run = lambda: live.start(live.topic_runs(stream(), P.topic_ttl_ms, "30 seconds"), str(path / "out"), str(path / "state"))
    told(spark, run(), path / "out")
    add([(1, 5_000, 900, "a", None, "x")])
    add([(9, ms + 1_000_000, 901, "z", None, "end")])
    got, query = told(spark, run(), path / "out")
    want, open_ = [], {}
    for c, at, o, _, _, t in rows:
        r = open_.get((c, t))
        if r and at - r[1] > P.topic_ttl_ms:
            want.append((c, t, *r))
            r = None
        open_[c, t] = (r[0], at, r[2] + 1) if r else (at, at, 1)
    want += [(*k, *r) for k, r in open_.items()]
    assert sorted((r.chat, r.topic, r.first_ms, r.last_ms, r.messages) for r in got) == sorted(want)
    assert (1, "x", 1_000, 11_000, 2) in want and (1, "x", 21_001, 21_001, 1) in want
    assert dropped(query) == 1
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # all runs but the mark's are gone


def test_late_rows_of_windows_are_left_out_and_counted(spark, arrive):
    add, stream, path = arrive
    rows = lambda o: stream().withColumn("event_id", F.col("ordinal"))
    for i in range(4):
        add([(1, 3_600_000 * i + k * 60_000, i * 10 + k, "a", None, "t") for k in range(10)])
    add([(1, 60_000, 99, "a", None, "t")])
    add([(1, 86_400_000, 100, "a", None, "t")])
    got, query = told(spark, live.start(live.buckets(rows(0), "10 minutes", "30 minutes"), str(path / "out"), str(path / "state")), path / "out")
    assert sorted((r.slot_ms, r.messages) for r in got) == [(3_600_000 * i, 10) for i in range(4)]
    assert dropped(query) == 1
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_import_in_any_order_and_again(spark, tmp_path):
    from murmuration.operators.imports import merge_import

    rnd = random.Random(3)
    rows = [(f"c{i % 7}", f"s{i % 60}", f"m{i % 60}", f"text {i % 60}", rnd.random() < 0.15, i) for i in range(200)]
    schema = "chat string, source_identity string, message_id string, text string, recalled boolean, place long"
    messages = StructType.fromDDL("chat string, source_identity string, message_id string, text string, recalled boolean, state string")
    chats = StructType.fromDDL("chat string, n long, gone long")
    made = lambda m: m.groupBy("chat").agg(F.count("*").alias("n"), F.count_if("recalled").alias("gone"))
    whole = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "chat string, source_identity string, message_id string, text string, recalled boolean, state string")
    want = sorted(tuple(r) for r in merge_import(none, whole).drop("change").collect())
    for trial in range(2):
        held = table.VersionedTable(spark, f"{tmp_path}/t{trial}", {"messages": messages, "chats": chats}, buckets=8)
        order = rnd.sample(rows, len(rows))
        for b in range(5):
            part = spark.createDataFrame(order[b * 40 : (b + 1) * 40], schema)
            assert table.import_batch(held, part, b, {"chats": made})
            assert not table.import_batch(held, part, b, {"chats": made})  # a batch that comes again
        assert sorted(tuple(r) for r in held.read("messages").collect()) == want
        assert sorted(tuple(r) for r in held.read("chats").collect()) == sorted(tuple(r) for r in made(held.read("messages")).collect())
    # A recall that comes late touches its own chat's bucket alone; a reader of the version before keeps it.
    before, old = held.manifest(), held.read("messages")
    alive = next(r for r in old.collect() if not r.recalled)
    assert table.import_batch(held, spark.createDataFrame([(alive.chat, alive.source_identity, alive.message_id, "x", True, 999)], schema), 5, {"chats": made})
    changed = {b for b, at in held.manifest()["buckets"].items() if before["buckets"].get(b) != at}
    assert len(changed) == 1
    now = {(r.chat, r.source_identity): r for r in held.read("messages").collect()}[alive.chat, alive.source_identity]
    assert now.recalled and now.text == "" and now.state == "skipped"
    assert {(r.chat, r.source_identity): r for r in old.collect()}[alive.chat, alive.source_identity].text == alive.text
    assert len(held.versions()) == held.keep


def test_import_stream_restarts(spark, tmp_path):
    schema = "chat string, source_identity string, message_id string, text string, recalled boolean, place long"
    messages = StructType.fromDDL("chat string, source_identity string, message_id string, text string, recalled boolean, state string")
    held = table.VersionedTable(spark, f"{tmp_path}/t", {"messages": messages}, buckets=4)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for batch in ([("a", "1", "m1", "hello", False, 0)], [("b", "2", "m2", "you", False, 1), ("a", "1", "m1", "hello", True, 2)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table.start_import(stream(), held, f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([("a", "1", "m1", "hello", False, 3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table.start_import(stream(), held, f"{tmp_path}/state").awaitTermination()
    assert sorted((r.chat, r.text, r.recalled) for r in held.read("messages").collect()) == [("a", "", True), ("b", "you", False)]
    assert held.manifest()["batch"] == 2


def test_arriving_rows_are_made_once(spark, sf):
    from pyspark.sql import functions as F

    from murmuration.plans.views import view
    from murmuration.queries_streams import FILES, _arriving

    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "long")
    msg = view(spark, sf, "v_event").select("chat", "ms", "event_id", (F.col("event_type") == "error").alias("recalled"))
    stream = _arriving(spark, sf, msg.withColumn("event_id", seen("event_id")), "event_id")
    query = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert made.value == msg.count() and [p["numInputRows"] > 0 for p in query.recentProgress] == [True] * (FILES + 1)
    assert spark.table("arrived").where("chat >= 0").select("event_id").distinct().count() == msg.count()
