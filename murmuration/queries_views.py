"""Queries of insights: views, evidence, life cycle, requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import insights, overview, rank, scores, topics, verify
from .plans.views import view
from .queries import _ASOF, _FAIL, _PRIO, _ROWS, NOW_S, P, _rows, _scored
from .registry import query


def _msg(spark, sf):
    return view(spark, sf, "v_msg")


def _reviewed(spark, sf):
    """What readers have seen: the 30th message of a chat; every fourth chat nothing."""
    return _msg(spark, sf).where("pos = 30 AND chat % 4 <> 0").select("chat", "ms", "ordinal")


_SEEN = "sn AS (SELECT chat, ms, ordinal FROM v_msg WHERE pos = 30 AND chat % 4 <> 0)"


@query(f"""WITH {_SEEN}, u AS (SELECT m.chat, count(*) FILTER (sn.chat IS NULL OR (m.ms, m.ordinal) > (sn.ms, sn.ordinal)) AS unread FROM v_msg m LEFT JOIN sn ON sn.chat = m.chat GROUP BY m.chat),
    p AS (SELECT topic_id % 20 AS chat, count(*) AS p0 FROM (SELECT *, {_PRIO} AS priority FROM v_insight) WHERE priority = 'P0' AND status = 'verified' AND lifecycle = 'open' GROUP BY 1)
    SELECT u.chat, unread, coalesce(p0, 0) AS p0 FROM u LEFT JOIN p ON p.chat = u.chat""")
def chat_summary(spark, sf):
    """Per chat: messages after the reader's cursor, open verified insights of the first priority."""
    msg = _msg(spark, sf)
    return overview.chat_summary(msg, _reviewed(spark, sf), _scored(spark, sf).withColumn("chat", F.col("topic_id") % 20))


_UNREAD = f"""{_SEEN}, un AS (SELECT insight_id, bool_or(sn.chat IS NULL OR (m.ms, m.ordinal) > (sn.ms, sn.ordinal)) AS unread FROM v_evidence e JOIN v_msg m ON m.message_id = e.message_id LEFT JOIN sn ON sn.chat = m.chat GROUP BY insight_id)"""


@query(f"WITH {_UNREAD} SELECT * FROM un")
def unread_insights(spark, sf):
    return insights.unread(view(spark, sf, "v_evidence"), _msg(spark, sf), _reviewed(spark, sf))


@query(f"WITH {_UNREAD} SELECT topic_id, count(*) AS insights, count(*) FILTER (unread) AS unread FROM v_insight JOIN un USING (insight_id) WHERE status <> 'rejected' GROUP BY topic_id HAVING count(*) FILTER (unread) > 0")
def unread_topics(spark, sf):
    rows = view(spark, sf, "v_insight").where("status <> 'rejected'").join(unread_insights(spark, sf), "insight_id")
    return rows.groupBy("topic_id").agg(F.count("*").alias("insights"), F.count_if("unread").alias("unread")).where("unread > 0")


_UNTIL = "(SELECT max(ms) - 3600000 FROM v_msg)"


@query(f"SELECT insight_id FROM v_evidence e LEFT JOIN v_msg m ON m.message_id = e.message_id GROUP BY insight_id HAVING bool_and(coalesce(ms < {_UNTIL}, false))")
def related(spark, sf):
    """Insights all of whose evidence is there and older than an hour at the end of the messages."""
    msg = _msg(spark, sf)
    end = msg.agg(F.max("ms")).first()[0]
    return insights.seen_before(view(spark, sf, "v_evidence"), msg, end - 3_600_000)


@query(f"""WITH d AS (SELECT insight_id, topic_id, bound_date, CASE WHEN NOT by_rule OR relation NOT IN ('before', 'at') OR bound_date IS NULL THEN 'uncertain'
      WHEN CASE WHEN bound_sec IS NOT NULL THEN CASE WHEN relation = 'before' THEN epoch(bound_date) + bound_sec <= {NOW_S} ELSE epoch(bound_date) + bound_sec < {NOW_S} END ELSE bound_date < DATE '2000-01-01' END THEN 'overdue' ELSE 'upcoming' END AS status FROM v_insight WHERE kind <> 'topic_summary')
    SELECT topic_id, insight_id, status, row_number() OVER (PARTITION BY topic_id ORDER BY status, bound_date NULLS FIRST, insight_id) AS place FROM d""")
def deadlines(spark, sf):
    rows = view(spark, sf, "v_insight").where("kind <> 'topic_summary'").withColumn("deadline", rank.deadline_status(NOW_S))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("deadline", F.asc_nulls_first("bound_date"), "insight_id"))
    return rows.select("topic_id", "insight_id", F.col("deadline").alias("status"), place.alias("place"))


@query("""SELECT chat, topic, message_id, list_filter(['@全体成员', '直接 @我'], lambda x: x = '@全体成员' AND mention = 'all' OR x = '直接 @我' AND mention = 'u' || (chat + 20))::VARCHAR AS reasons
    FROM v_msg WHERE NOT recalled AND NOT is_system AND mention IN ('all', 'u' || (chat + 20))""")
def mentions_view(spark, sf):
    """Mentions of everybody or of the chat's owner, with all reasons."""
    m = F.col("mention")
    me = F.concat(F.lit("u"), (F.col("chat") + 20).cast("string"))
    reasons = F.array_compact(F.array(F.when(m == "all", "@全体成员"), F.when(m == me, "直接 @我")))
    rows = _msg(spark, sf).where("NOT recalled AND NOT is_system").withColumn("reasons", reasons).where("size(reasons) > 0")
    return rows.select("chat", "topic", "message_id", F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]")).alias("reasons"))


@query(f"""WITH {_FAIL} SELECT chat, topic, message_id FROM v_msg WHERE NOT recalled AND mention = 'all' AND message_id NOT IN (SELECT message_id FROM ev WHERE failure IS NULL)""")
def mention_insights(spark, sf):
    """Messages that mention everybody and that no good evidence covers: each becomes an insight of its own."""
    covered = verify.evidence_failures(view(spark, sf, "v_evidence"), _msg(spark, sf)).where("failure IS NULL").select("message_id")
    return _msg(spark, sf).where("NOT recalled AND mention = 'all'").join(covered, "message_id", "left_anti").select("chat", "topic", "message_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY chat, topic ORDER BY ms, ordinal) AS place FROM v_msg WHERE NOT recalled) SELECT chat, topic, message_id, left(text, 60) AS quote, place FROM r WHERE place <= 2")
def summary_insights(spark, sf):
    return insights.first_evidence(_msg(spark, sf))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'resolve' WHEN 'A' THEN 'reopen' ELSE 'dismiss' END AS action, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem)
    SELECT insight_id, CASE action WHEN 'resolve' THEN 'resolved' WHEN 'dismiss' THEN 'dismissed' WHEN 'reopen' THEN 'open' ELSE lifecycle END AS lifecycle FROM v_insight LEFT JOIN a ON insight_id = 'i' || l_orderkey AND k = 1""")
def lifecycle_apply(spark, sf):
    actions = view(spark, sf, "lineitem").selectExpr("concat('i', l_orderkey) AS insight_id", "l_shipdate AS at", "named_struct('n', l_linenumber, 'p', l_partkey, 's', l_suppkey) AS tie", "CASE l_returnflag WHEN 'R' THEN 'resolve' WHEN 'A' THEN 'reopen' ELSE 'dismiss' END AS action")
    both = view(spark, sf, "v_insight").join(insights.last_action(actions), "insight_id", "left")
    to = F.when(F.col("action") == "resolve", "resolved").when(F.col("action") == "dismiss", "dismissed").when(F.col("action") == "reopen", "open").otherwise(F.col("lifecycle"))
    return both.select("insight_id", to.alias("lifecycle"))


@query("""WITH e AS (SELECT insight_id, message_id, min(CASE WHEN idx <= 2 THEN idx ELSE NULL END) AS a, min(CASE WHEN idx >= 2 AND l % 3 = 0 THEN idx END) AS b FROM (SELECT *, substr(insight_id, 2)::BIGINT AS l FROM v_evidence) GROUP BY ALL),
    g AS (SELECT insight_id, string_agg(message_id, ',' ORDER BY a IS NULL, coalesce(a, b), message_id) AS evidence FROM e WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY insight_id)
    SELECT insight_id, CASE WHEN o_orderkey % 5 = 1 THEN 'open' ELSE lifecycle END AS lifecycle, coalesce(evidence, '') AS evidence FROM v_insight LEFT JOIN g USING (insight_id) WHERE o_orderkey % 5 <> 1 OR o_orderkey % 3 = 0""")
def insight_upsert(spark, sf):
    """Four of five insights are stored, with their first evidence; every third is proposed with later evidence."""
    ins = view(spark, sf, "v_insight").selectExpr("insight_id", "kind AS title", "lifecycle", "o_orderkey AS k")

    def gathered(rows):
        each = rows.groupBy("insight_id", "message_id").agg(F.min("idx").alias("idx")).groupBy("insight_id")
        return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "message_id"))), lambda x: x["message_id"]).alias("evidence"))

    ev = view(spark, sf, "v_evidence")
    none = F.array().cast("array<string>")
    stored = ins.where("k % 5 <> 1").join(gathered(ev.where("idx <= 2")), "insight_id", "left").withColumn("evidence", F.coalesce("evidence", none))
    later = gathered(ev.where("idx >= 2"))
    new = ins.where("k % 3 = 0").join(later, "insight_id", "left").withColumn("evidence", F.coalesce("evidence", none))
    first = ins.where("k % 5 = 1 AND k % 3 = 0").select("insight_id").join(gathered(ev.where("idx <= 2")).withColumnRenamed("evidence", "early"), "insight_id", "left")
    new = new.join(first, "insight_id", "left").withColumn("evidence", F.array_union(F.coalesce("early", none), "evidence"))
    out = insights.upsert(stored.select("insight_id", "title", "lifecycle", "evidence"), new.select("insight_id", "title", "evidence"))
    return out.select("insight_id", "lifecycle", F.array_join("evidence", ",").alias("evidence"))


@query(f"""WITH e AS (SELECT e.*, m.ms, contains(m.text, 'click') AS said FROM v_evidence e LEFT JOIN v_msg m ON m.message_id = e.message_id)
    SELECT insight_id, coalesce(arg_min(ms, (idx, message_id)) FILTER (ms IS NOT NULL AND said), arg_min(ms, (idx, message_id)) FILTER (ms IS NOT NULL), {NOW_S}000) AS anchor_ms FROM e GROUP BY insight_id""")
def deadline_anchor(spark, sf):
    return insights.deadline_anchor(view(spark, sf, "v_evidence"), _msg(spark, sf), F.lit("click"), NOW_S * 1000, "insight_id")


@query("""SELECT insight_id, coalesce(bound_date, CASE WHEN o_orderkey % 9 <> 0 THEN DATE '2001-01-01' + (o_orderkey % 300)::INT END) AS bound_date, CASE WHEN bound_date IS NOT NULL THEN 'rule' WHEN o_orderkey % 9 <> 0 THEN 'guess' END AS by,
    CASE WHEN bound_date IS NOT NULL THEN 0.9 WHEN o_orderkey % 9 <> 0 THEN 0.5 END::DOUBLE AS confidence FROM v_insight""")
def deadline_fallback(spark, sf):
    """A guessed date counts, with half the confidence, where the rules gave none and the guess is a date."""
    guess = F.when(F.col("o_orderkey") % 9 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("o_orderkey") % 300).cast("int")).cast("string")).otherwise("soon")
    return insights.deadline_fallback(view(spark, sf, "v_insight").withColumn("guess", guess))


# Requests.
@query(_ROWS + _ASOF + """, sc AS (SELECT ac.*, round(0.3 * coalesce(edges, 0) / 3.0 - 0.1 * ((at_ms - ms) / 21600000.0), 9)::DOUBLE AS score FROM ac LEFT JOIN ed USING (chat, burst, topic)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY chat, burst ORDER BY score DESC, ms DESC, topic) AS rank, count(*) OVER (PARTITION BY chat, burst) AS n FROM sc),
    us AS (SELECT chat, burst, topic, rank, sum(len(topic) + 40) OVER (PARTITION BY chat, burst ORDER BY rank)::BIGINT AS used FROM rk WHERE n <= 40 OR rank <= 5)
    SELECT * FROM us WHERE used <= 120""")
def candidate_trim(spark, sf):
    """The best candidates of a burst whose entries fit into a request of 120 characters."""
    ranked = topics.topic_candidates(*_rows(spark, sf), P).withColumn("size", F.length("topic") + 40)
    return insights.within_size(ranked, 120, "chat", "burst").select("chat", "burst", "topic", "rank", "used")


@query("SELECT chat, (pos - 1) // 40 AS batch, message_id || '_' || label AS question FROM v_msg CROSS JOIN (VALUES ('todo'), ('announcement'), ('mention')) l(label) WHERE NOT recalled AND state = 'pending'")
def question_rows(spark, sf):
    """A question per pending message and label, in batches of forty places."""
    rows = _msg(spark, sf).where("NOT recalled AND state = 'pending'").withColumn("label", F.explode(F.array(*map(F.lit, ("todo", "announcement", "mention")))))
    return rows.select("chat", F.floor((F.col("pos") - 1) / 40).alias("batch"), F.concat_ws("_", "message_id", "label").alias("question"))


@query("""WITH q AS (SELECT sha256(text) AS request_key, count(*) AS copies FROM v_msg WHERE NOT recalled GROUP BY text)
    SELECT * FROM q WHERE request_key NOT IN (SELECT sha256(text) FROM v_msg WHERE state = 'skipped')""")
def uncached_requests(spark, sf):
    msg = _msg(spark, sf)
    answered = msg.where("state = 'skipped'").select(F.sha2("text", 256).alias("request_key"))
    return insights.not_answered(msg.where("NOT recalled"), answered, "text")


@query("""SELECT l_orderkey AS subject, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.05) > 0 AS todo, count(*) FILTER (l_returnflag = 'A' AND l_discount >= 0.05) > 0 AS announcement, max(l_tax) AS confidence FROM lineitem GROUP BY l_orderkey""")
def signals(spark, sf):
    """Answers per subject and label, pivoted: a label holds if its probability reaches the threshold."""
    label = F.when(F.col("l_returnflag") == "R", "todo").when(F.col("l_returnflag") == "A", "announcement").otherwise("none")
    return scores.label_signals(view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subject"), label.alias("label"), F.col("l_discount").alias("p"), F.col("l_tax").alias("sure")), {"todo": 0.05, "announcement": 0.05})


@query("""WITH r AS (SELECT topic_id, insight_id, status, row_number() OVER (PARTITION BY topic_id ORDER BY CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE 1 END, status, insight_id) AS place FROM v_insight),
    l AS (SELECT *, lag((status, insight_id)) OVER (PARTITION BY topic_id ORDER BY place) AS b FROM r) SELECT topic_id, insight_id, place FROM l WHERE b > (status, insight_id)""")
def snapshot_check(spark, sf):
    """Rows of a listing that are out of order (a few were moved to its head)."""
    rows = view(spark, sf, "v_insight")
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.when(F.col("o_orderkey") % 40 == 0, 0).otherwise(1), "status", "insight_id"))
    listed = rows.withColumn("place", place)
    return insights.order_breaks(listed, [F.col("status"), F.col("insight_id")], "place", "topic_id").select("topic_id", "insight_id", "place")


@query()
def thread_one_to_one(spark, sf):
    """Overlap of topics with threads by sender and day, per chat; best assignments have no SQL, tests hold them against all permutations."""
    return insights.one_to_one(_msg(spark, sf).selectExpr("chat", "topic AS p", "concat(sender, '_', ms div 86400000) AS g"))


@query(f"""WITH m AS (SELECT * FROM v_msg), s AS (SELECT chat, 'topics' AS section, count(DISTINCT topic) AS n FROM m WHERE NOT recalled GROUP BY chat UNION ALL SELECT chat, 'mentions', count(*) FROM m WHERE NOT recalled AND mention = 'all' GROUP BY chat
    UNION ALL SELECT chat, 'pending', count(*) FROM m WHERE state = 'pending' GROUP BY chat UNION ALL SELECT topic_id % 20, 'insights', count(*) FROM v_insight WHERE status <> 'rejected' GROUP BY 1) SELECT * FROM s""")
def overview_sections(spark, sf):
    """Sections of an overview and their sizes, tagged, as they are exported."""
    msg = _msg(spark, sf)
    size = lambda rows, name, n: rows.groupBy("chat").agg(n.alias("n")).select("chat", F.lit(name).alias("section"), "n")
    parts = [
        size(msg.where("NOT recalled"), "topics", F.countDistinct("topic")), size(msg.where("NOT recalled AND mention = 'all'"), "mentions", F.count("*")), size(msg.where("state = 'pending'"), "pending", F.count("*")),
        size(view(spark, sf, "v_insight").where("status <> 'rejected'").withColumn("chat", F.col("topic_id") % 20), "insights", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
