"""Adapter views: the driver's tables as message, topic, insight and label tables.

The text of a view is the same for both engines but for the names in ENGINES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written

ENGINES = {
    "spark": {"ms": "unix_millis(CAST(ts AS TIMESTAMP))", "odate": "CAST(o_orderdate AS DATE)"},
    "duckdb": {"ms": "epoch_us(ts) // 1000", "odate": "CAST(o_orderdate AS DATE)"},
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_event": """
        SELECT event_id, user_id, event_type, value, {ms} AS ms, user_id % 20 AS chat,
          row_number() OVER (PARTITION BY user_id % 20 ORDER BY {ms}, event_id) AS pos FROM events""",
    "v_msg": """
        SELECT concat('m', event_id) AS message_id, chat, ms, event_id AS ordinal, pos, concat('u', user_id) AS sender,
          event_type = 'error' AS recalled, event_id % 53 = 0 AS is_system,
          CASE event_id % 6 WHEN 0 THEN '[图片]' WHEN 1 THEN concat('[foo] ', event_type) WHEN 2 THEN concat('[系统:x] see https://e.example/', user_id, '. and')
            ELSE concat(event_type, ' ', CAST(floor(value) AS BIGINT)) END AS text,
          CASE WHEN event_id % 3 = 0 THEN pos - (event_id % 7 + 1) END AS reply_pos,
          CASE WHEN event_id % 97 = 0 THEN 'all' WHEN event_id % 4 = 0 THEN concat('u', (user_id * 7 + event_id) % 150) END AS mention,
          CASE WHEN event_id % 11 = 10 AND event_id > 200 THEN 'pending' WHEN event_id % 11 = 9 THEN 'failed' WHEN event_id % 11 = 8 THEN 'skipped' ELSE 'done' END AS state,
          concat('t', chat, '_', CAST(floor(ms / 10800000) AS BIGINT), '_', user_id % 3) AS topic
        FROM v_event""",
    "v_relation": """
        SELECT concat('q', e.event_id) AS rel_id, e.chat, e.user_id % 3 AS topic, 'question' AS kind, concat('m', e.event_id) AS source_id, e.event_type AS quote,
          CAST(NULL AS STRING) AS target_id, e.ms AS source_ms, CAST(NULL AS BIGINT) AS target_ms, CAST(NULL AS STRING) AS completeness, e.event_id % 13 <> 0 AS valid
        FROM v_event e
        UNION ALL
        SELECT concat('a', t.event_id), s.chat, s.user_id % 3, 'answers', concat('m', s.event_id), s.event_type, concat('m', t.event_id), s.ms, t.ms,
          CASE WHEN t.event_id % 2 = 0 THEN 'full' ELSE 'partial' END, t.event_id % 17 <> 0
        FROM v_event s JOIN v_event t ON s.chat = t.chat AND t.event_id % 3 = 0 AND s.pos = t.pos - (t.event_id % 7 + 1)""",
    "v_insight": """
        SELECT concat('i', o_orderkey) AS insight_id, o_custkey % 50 AS topic_id,
          CASE o_orderkey % 5 WHEN 0 THEN 'todo' WHEN 1 THEN 'announcement' WHEN 2 THEN 'decision' WHEN 3 THEN 'mention_me' ELSE 'topic_summary' END AS kind,
          CASE o_custkey % 4 WHEN 0 THEN 'me' WHEN 1 THEN 'all' WHEN 2 THEN 'other' ELSE 'unknown' END AS assignee,
          CASE WHEN o_orderkey % 4 = 0 THEN {odate} END AS bound_date, CASE WHEN o_orderkey % 8 = 0 THEN 64800 END AS bound_sec,
          CASE o_orderkey % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'at' ELSE 'after' END AS relation, o_orderkey % 7 <> 0 AS by_rule,
          (o_orderkey % 101) / 100.0 AS p_action, (o_custkey % 97) / 96.0 AS p_chitchat, (o_orderkey % 21) / 10.0 AS urgency,
          CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'open' END AS lifecycle,
          CASE o_orderkey % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'unverified' ELSE 'verified' END AS status,
          o_totalprice, o_orderkey, o_custkey FROM orders""",
    "v_evidence": """
        SELECT concat('i', l_orderkey) AS insight_id, concat('m', l_partkey * 7) AS message_id, l_linenumber AS idx,
          CASE l_linenumber % 4 WHEN 0 THEN 'ab' WHEN 1 THEN 'click' WHEN 2 THEN ' v i e w' ELSE 'foo' END AS quote FROM lineitem""",
    "v_prob": "SELECT d.doc_id, (n_chars % 101) / 100.0 AS p, quality AS y, lang AS model, source AS task FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
    "v_cluster": "SELECT vec_id, vec_id % 7 AS p, label AS g FROM embeddings WHERE label IS NOT NULL",
}


#: Places in a chat are counted by spans of time.
SPAN_MS = 600_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_event as its SQL has it, but no task sorts a chat: places are counted within spans of time, plus the spans before."""
    rows = spark.sql(f"SELECT event_id, user_id, event_type, value, {ENGINES['spark']['ms']} AS ms, user_id % 20 AS chat FROM {{events}}", events=view(spark, sf_dir, "events"))
    rows = rows.withColumn("_span", F.floor(F.col("ms") / SPAN_MS))
    spans = rows.groupBy("chat", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("chat").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("chat").alias("_c"), F.col("_span").alias("_s"), before.alias("_before"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("chat", "_span").orderBy("ms", "event_id")))
    both = rows.join(spans, F.col("chat").eqNullSafe(F.col("_c")) & F.col("_span").eqNullSafe(F.col("_s")))
    return both.select("event_id", "user_id", "event_type", "value", "ms", "chat", (F.col("_before") + F.col("_k")).alias("pos"))


#: Views that most queries read; they are written once a run.
SHARED = ("v_event", "v_msg")
_once: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in SHARED:
        return _made(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _once:
        _once[key] = written(_events(spark, sf_dir) if name == "v_event" else _made(spark, sf_dir, name), name)
    path = _once[key].written_path
    return spark.read.schema(_once[key].schema).parquet(path)


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, used = VIEWS[name], {}
    for other in [*TABLES, *VIEWS]:
        if other != name and f" {other}" in f" {text} ".replace("\n", " ") and any(f"{w} {other}" in text for w in ("FROM", "JOIN")):
            used[other] = view(spark, sf_dir, other)
    for other in used:
        text = text.replace(f"FROM {other}", f"FROM {{{other}}}").replace(f"JOIN {other}", f"JOIN {{{other}}}")
    for k, v in ENGINES["spark"].items():
        text = text.replace(f"{{{k}}}", v)
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """SQL for DuckDB: the query with the views that it needs before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n].format(**ENGINES['duckdb'])})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
