"""Queries of online assignment, requests, answers and the insights made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import assign, contracts, requests, segment, topics, verify
from .plans.views import view
from .queries import _ASOF, _PAIRS, _PRIO, _PRIOR, _ROWS, _VER, P, _rows, _scored, _states
from .registry import query


def _msg(spark, sf):
    return view(spark, sf, "v_msg")


@query()
def assign_topics(spark, sf):
    """No SQL: each choice rests on all before it. The tests hold it against a plain loop."""
    msg = _msg(spark, sf)
    return assign.assign_online(msg, segment.bursts(msg, P), P)


@query()
def assign_late(spark, sf):
    """Every third burst came late: it finds its topic among those of the others, by their states. No SQL, as above."""
    msg = _msg(spark, sf)
    found = segment.bursts(msg, P)
    late = found.where(F.col("burst") % 3 == 0).select("chat", "pos")
    have = msg.where("NOT recalled").join(late, ["chat", "pos"], "left_anti").select("chat", "pos", "topic")
    return assign.assign_online(msg, found, P, assigned=have, topics=_states(msg))


@query()
def assign_answered(spark, sf):
    """Answers decide: choices by rank with a confidence, and reviews of those that are not sure. No SQL, as above."""
    msg = _msg(spark, sf)
    found = segment.bursts(msg, P)
    n = F.col("burst")
    answers = found.select("chat", "burst").distinct().select("chat", "burst", F.when(n % 5 > 0, n % 3).alias("choice"), (n % 101 / 100).alias("confidence"), F.when(n % 2 == 0, n % 4).alias("review"))
    return assign.assign_online(msg, found, P, answers=answers.where(n % 11 > 0))


_ITEMS = "it AS (SELECT i.insight_id, i.kind, m.chat, m.topic FROM v_insight i JOIN v_evidence e ON e.insight_id = i.insight_id AND e.idx = 1 JOIN v_msg m ON m.message_id = e.message_id WHERE i.lifecycle = 'open')"


@query(f"""WITH {_ITEMS}, v AS (SELECT *, state IN ('pending', 'failed') AS new FROM v_msg WHERE NOT recalled),
    n AS (SELECT *, row_number() OVER (PARTITION BY chat, topic ORDER BY ms, ordinal) AS k FROM v WHERE new), t AS (SELECT DISTINCT chat, topic FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY chat, topic ORDER BY ms DESC, ordinal DESC) AS k FROM v SEMI JOIN t USING (chat, topic) WHERE NOT new),
    s AS (SELECT DISTINCT it.chat, it.topic, m.message_id, m.ms, m.ordinal, m.sender, m.text FROM it SEMI JOIN t USING (chat, topic) JOIN v_evidence e ON e.insight_id = it.insight_id JOIN v m ON m.message_id = e.message_id AND m.chat = it.chat
      WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.chat = it.chat AND n.topic = it.topic AND n.message_id = m.message_id) AND NOT EXISTS (SELECT 1 FROM o WHERE o.k <= 5 AND o.chat = it.chat AND o.topic = it.topic AND o.message_id = m.message_id)),
    c AS (SELECT chat, topic, 0 AS late, -ms AS w1, -ordinal AS w2, ms, sender, text FROM o WHERE k <= 5 UNION ALL SELECT chat, topic, 1, ms, ordinal, ms, sender, text FROM s),
    r AS (SELECT chat, topic, 'new' AS part, 'n' || k AS ref, ms, sender, text FROM n UNION ALL SELECT chat, topic, 'context', 'c' || row_number() OVER (PARTITION BY chat, topic ORDER BY late, w1, w2), ms, sender, text FROM c),
    e AS (SELECT chat, topic, 'e' || row_number() OVER (PARTITION BY chat, topic ORDER BY insight_id) AS ref, kind, insight_id FROM it SEMI JOIN t USING (chat, topic))
    SELECT chat, topic, part, ref, CAST(to_json({{'ref': ref, 'sender': sender, 'sent_at': ms, 'text': text}}) AS VARCHAR) AS body FROM r
    UNION ALL SELECT chat, topic, 'open_item', ref, CAST(to_json({{'ref': ref, 'kind': kind, 'title': insight_id}}) AS VARCHAR) FROM e""")
def extraction_requests(spark, sf):
    msg, evidence = _msg(spark, sf), view(spark, sf, "v_evidence")
    items = view(spark, sf, "v_insight").where("lifecycle = 'open'").select("insight_id", "kind")
    items = items.join(evidence.where("idx = 1").select("insight_id", "message_id"), "insight_id").join(msg.select("message_id", "chat", "topic"), "message_id").drop("message_id")
    return requests.extraction_rows(msg, items, evidence)


@query(_ROWS + _ASOF + """, sc AS (SELECT ac.*, round(0.3 * coalesce(edges, 0) / 3.0 - 0.1 * ((at_ms - ms) / 21600000.0), 9)::DOUBLE AS score FROM ac LEFT JOIN ed USING (chat, burst, topic)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY chat, burst ORDER BY score DESC, ms DESC, topic) AS rank, count(*) OVER (PARTITION BY chat, burst) AS n FROM sc),
    op AS (SELECT chat, burst, list({'ref': 'T' || (rank - 1), 'title': topic} ORDER BY rank) AS candidate_topics FROM rk WHERE n <= 40 OR rank <= 5 GROUP BY chat, burst),
    sa AS (SELECT chat, burst, list(text ORDER BY pos) AS new_messages FROM r WHERE NOT recalled GROUP BY chat, burst)
    SELECT chat, burst, CAST(to_json({'candidate_topics': candidate_topics, 'new_messages': new_messages}) AS VARCHAR) AS request FROM op JOIN sa USING (chat, burst)""")
def choice_rows(spark, sf):
    rows, msg = _rows(spark, sf)
    return requests.choice_rows(topics.topic_candidates(rows, msg, P), rows)


@query("""WITH p AS (SELECT s.chat, least(s.topic, t.topic) AS a, greatest(s.topic, t.topic) AS b, s.message_id, s.pos, s.reply_pos FROM v_msg s JOIN v_msg t ON t.chat = s.chat AND t.pos = s.reply_pos AND t.pos < s.pos
      WHERE NOT s.recalled AND NOT t.recalled AND s.topic <> t.topic),
    k AS (SELECT *, row_number() OVER (PARTITION BY chat, a, b ORDER BY message_id) AS k, count(*) OVER (PARTITION BY chat, a, b) AS n FROM p),
    c AS (SELECT chat, a, b, pos FROM k WHERE k <= 3 AND n >= 2 UNION SELECT chat, a, b, reply_pos FROM k WHERE k <= 3 AND n >= 2),
    m AS (SELECT c.*, v.topic, v.reply_pos, v.text, 'n' || row_number() OVER (PARTITION BY c.chat, a, b ORDER BY c.pos) AS ref FROM c JOIN v_msg v ON v.chat = c.chat AND v.pos = c.pos)
    SELECT m.chat, m.a, m.b, CAST(to_json(list({'ref': m.ref, 'topic_ref': CASE WHEN m.topic = m.a THEN 'T0' ELSE 'T1' END, 'reply_to_ref': q.ref, 'text': m.text} ORDER BY m.pos)) AS VARCHAR) AS request
    FROM m LEFT JOIN m q ON q.chat = m.chat AND q.a = m.a AND q.b = m.b AND q.pos = m.reply_pos GROUP BY m.chat, m.a, m.b""")
def merge_rows(spark, sf):
    return requests.merge_rows(_msg(spark, sf))


@query("""WITH r AS (SELECT chat, (pos - 1) // 40 AS batch, topic, (pos - 1) % 40 + 1 AS place, 'n' || ((pos - 1) % 40 + 1) AS ref FROM v_msg WHERE NOT recalled),
    n AS (SELECT *, 'n' || row_number() OVER (PARTITION BY chat, batch, topic ORDER BY place) AS new FROM r),
    c AS (SELECT chat, batch, topic, CASE WHEN place % 5 = 0 THEN 'n' || (place + 1) ELSE ref END AS ref FROM r)
    SELECT c.chat, c.batch, c.topic, c.ref, coalesce(n.new, c.ref) AS new_ref FROM c LEFT JOIN n USING (chat, batch, topic, ref)""")
def reference_remap(spark, sf):
    """Evidence cites the places of a batch of forty; every fifth cites its neighbour, which may be in another topic."""
    refs = _msg(spark, sf).where("NOT recalled").selectExpr("chat", "floor((pos - 1) / 40) AS batch", "topic", "(pos - 1) % 40 + 1 AS place")
    name = F.concat(F.lit("n"), F.col("place").cast("string"))
    cited = refs.withColumn("place", F.when(F.col("place") % 5 == 0, F.col("place") + 1).otherwise(F.col("place"))).select("chat", "batch", "topic", name.alias("ref"))
    return requests.remapped(cited, refs.withColumn("ref", name), "chat", "batch").select("chat", "batch", "topic", "ref", "new_ref")


@query("""WITH a AS (SELECT o_orderkey AS answer_id, o_custkey AS request_key, CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'topic_pair' ELSE 'message' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('m', o_orderkey) END AS id,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS own FROM orders), c AS (SELECT c_custkey AS request_key, c_mktsegment AS model FROM customer WHERE c_custkey % 3 <> 0)
    SELECT answer_id, request_key, coalesce(own, model, 'unknown') AS model, kind <> 'unknown' AND id <> '' AS aligned, CASE WHEN kind <> 'unknown' AND id <> '' THEN kind ELSE 'unknown' END AS subject_kind,
      CASE WHEN kind <> 'unknown' AND id <> '' THEN id ELSE 'unavailable' END AS subject_id FROM a LEFT JOIN c USING (request_key)""")
def answer_log(spark, sf):
    answers = view(spark, sf, "orders").selectExpr(
        "o_orderkey AS answer_id", "o_custkey AS request_key", "CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'topic_pair' ELSE 'message' END AS subject_kind",
        "IF(o_orderkey % 7 = 0, '', concat('m', o_orderkey)) AS subject_id", "IF(o_orderkey % 4 = 0, o_orderpriority, NULL) AS own_model",
    )
    return requests.answer_log(answers, view(spark, sf, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS request_key", "c_mktsegment AS model"))


@query(f"""WITH {_PAIRS}, u AS (SELECT *, CASE WHEN ordinal % 9 <> 0 THEN topic END AS own FROM v_msg), g AS (SELECT chat, a, b FROM p GROUP BY chat, a, b HAVING count(*) >= 2), n AS (SELECT chat, count(*) AS k FROM g GROUP BY chat)
    SELECT u.chat, count(*) FILTER (NOT recalled AND state IN ('pending', 'failed')) AS messages, count(*) FILTER (NOT recalled AND state IN ('pending', 'failed') AND own IS NULL) AS unassigned_messages,
      count(DISTINCT own) FILTER (NOT recalled AND state IN ('pending', 'failed')) AS dirty_topics, coalesce(any_value(k), 0) AS merge_candidates, max(ms) AS snapshot_ms FROM u LEFT JOIN n ON n.chat = u.chat GROUP BY u.chat""")
def work_plan_full(spark, sf):
    """What an analysis of a chat would do; every ninth message has no topic yet."""
    todo = ~F.col("recalled") & F.col("state").isin("pending", "failed")
    msg = _msg(spark, sf)
    own = F.when(F.col("ordinal") % 9 != 0, F.col("topic"))
    each = msg.groupBy("chat").agg(
        F.count_if(todo).alias("messages"), F.count_if(todo & own.isNull()).alias("unassigned_messages"), F.countDistinct(F.when(todo, own)).alias("dirty_topics"), F.max("ms").alias("snapshot_ms"))
    merges = topics.merge_candidates(msg).groupBy("chat").agg(F.count("*").alias("merge_candidates"))
    return each.join(merges, "chat", "left").fillna(0, ["merge_candidates"])


@query("""WITH f AS (SELECT insight_id, arg_min(message_id, (idx, message_id)) AS message_id FROM v_evidence GROUP BY insight_id)
    SELECT insight_id, unnest(list_filter(['kind:' || kind, 'has_deadline:' || CASE WHEN bound_date IS NOT NULL THEN 'true' ELSE 'false' END, 'topic:' || topic_id, 'sender:' || m.sender], lambda x: x IS NOT NULL)) AS feature
    FROM v_insight LEFT JOIN f USING (insight_id) LEFT JOIN v_msg m ON m.message_id = f.message_id""")
def insight_features_sender(spark, sf):
    """Features of an insight, the sender of its first evidence among them."""
    first = view(spark, sf, "v_evidence").groupBy("insight_id").agg(F.min_by("message_id", F.struct("idx", "message_id")).alias("message_id"))
    sender = first.join(_msg(spark, sf).select("message_id", "sender"), "message_id").select("insight_id", "sender")
    rows = view(spark, sf, "v_insight").join(sender, "insight_id", "left")
    name = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    features = F.array(name("kind:", F.col("kind")), name("has_deadline:", F.col("bound_date").isNotNull()), name("topic:", F.col("topic_id")), name("sender:", F.col("sender")))
    return rows.select("insight_id", F.explode(F.array_compact(features)).alias("feature"))


@query(f"""WITH {_VER}, p AS (SELECT * FROM v_insight WHERE kind IN ('todo', 'announcement', 'decision') AND o_orderkey % 45 BETWEEN 1 AND 40 AND o_orderkey % 230 <= 200 AND NOT (o_orderkey % 6 = 0 AND o_custkey % 4 = 0 AND kind <> 'todo'))
    SELECT insight_id, topic_id, kind, assignee, bound_date, CASE WHEN failures = '' THEN 'verified' ELSE 'rejected' END AS verdict, failures, {_PRIO} AS priority, round({_PRIOR}::FLOAT::DOUBLE, 4) AS score
    FROM p JOIN (SELECT insight_id, failures FROM ve) USING (insight_id)""")
def insights_build(spark, sf):
    """Proposals that keep the contract, with verdict on their evidence, priority and score."""
    rows = _scored(spark, sf).selectExpr(
        "*", "repeat('t', CAST(o_orderkey % 45 AS INT)) AS title", "repeat('s', CAST(o_orderkey % 230 AS INT)) AS summary",
        "IF(o_orderkey % 6 = 0, insight_id, NULL) AS update_of", "CASE WHEN o_orderkey % 6 = 0 THEN IF(o_custkey % 4 = 0, 'todo', kind) END AS update_kind",
    )
    kept = rows
    for ok in contracts.proposal_rules().values():
        kept = kept.where(F.coalesce(ok, F.lit(False)))
    checked = verify.verify_evidence(kept, view(spark, sf, "v_evidence"), _msg(spark, sf)).select("insight_id", F.col("status").alias("verdict"), "failures")
    return kept.join(checked, "insight_id").select("insight_id", "topic_id", "kind", "assignee", "bound_date", "verdict", "failures", "priority", "score")
