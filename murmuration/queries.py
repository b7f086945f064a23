"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import evaluate, overview, rank, relations, segment, topics, verify
from .params import Params
from .plans.views import view
from .registry import ORACLE, QUERIES, query  # noqa: F401

#: The bench runs these.
HEADLINE = ["hot_topics", "bursts", "interleave", "topic_candidates", "verify_evidence", "evidence_view", "inbox", "usage_rollup", "merge_candidates", "calibration", "ari", "ndcg"]
P = Params()
NOW_S = 946_684_800  # 2000-01-01


def _msg(spark, sf):
    return view(spark, sf, "v_msg")


_TEXT = r"""regexp_replace(regexp_replace(text, '\[(?:图片|文件|语音|视频|合并转发|表情|系统|system|json|location)(?::[^\]]*)?\]|(\[[^\]]*\])', '\1', 'g'), '\s', '', 'g')"""


@query(rf"""
    WITH m AS (SELECT *, {_TEXT} AS s, max(ms) OVER (PARTITION BY chat) AS until, ms // 600000 AS slot FROM v_msg),
    v AS (SELECT *, CASE WHEN regexp_matches(s, '[\p{{L}}\p{{N}}]') THEN s END AS said FROM m WHERE NOT recalled AND NOT is_system),
    r AS (SELECT *, row_number() OVER (PARTITION BY chat, topic, sender, slot, said ORDER BY ms, ordinal) AS again FROM v),
    k AS (SELECT *, CASE WHEN said IS NOT NULL AND again = 1 THEN row_number() OVER (PARTITION BY chat, topic, sender, slot, said IS NOT NULL AND again = 1 ORDER BY ms, ordinal) END AS place FROM r)
    SELECT chat, topic, count(*) AS messages, count(said) AS meaningful, count(DISTINCT CASE WHEN said IS NOT NULL THEN sender END) AS participants,
      round(coalesce(sum(CASE WHEN place <= 3 THEN exp((ms - until) / 21600000.0) END), 0) + 2.0 * count(DISTINCT CASE WHEN said IS NOT NULL THEN sender END), 6)::DOUBLE AS score,
      max(CASE WHEN said IS NOT NULL THEN ms END) AS last_ms
    FROM k GROUP BY chat, topic HAVING count(said) > 0""")
def hot_topics(spark, sf):
    msg = _msg(spark, sf)
    return overview.hot_topics(msg.join(msg.groupBy("chat").agg(F.max("ms").alias("end_ms")), "chat"), "end_ms")


_SESSION = """s AS (SELECT *, sum(o) OVER (PARTITION BY chat ORDER BY pos) AS session FROM (
      SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY chat ORDER BY pos) < 1800000 THEN 0 ELSE 1 END AS o FROM v_msg))"""


@query(f"WITH {_SESSION} SELECT chat, session::BIGINT AS session, count(*) AS messages, min(ms) AS first_ms, max(ms) AS last_ms FROM s GROUP BY chat, session")
def strong_sessions(spark, sf):
    rows = segment.strong_sessions(_msg(spark, sf), P.strong_gap_ms)
    return rows.groupBy("chat", "session").agg(F.count("*").alias("messages"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


_BURST = """
    WITH RECURSIVE b(chat, pos, ms, sender, message_id, start, size) AS (
      SELECT chat, pos, ms, sender, message_id, pos, 1 FROM v_msg WHERE pos = 1
      UNION ALL
      SELECT chat, pos, ms, sender, message_id, CASE WHEN joins THEN start ELSE pos END, CASE WHEN joins THEN size + 1 ELSE 1 END FROM (
        SELECT m.chat, m.pos, m.ms, m.sender, m.message_id, b.start, b.size, b.size < 20 AND m.ms - b.ms < 1800000 AND
          (m.ms - b.ms < 300000 OR coalesce(m.reply_pos >= b.start AND m.reply_pos < m.pos, false) OR m.sender = b.sender AND m.ms - b.ms <= 60000) AS joins
        FROM b JOIN v_msg m ON m.chat = b.chat AND m.pos = b.pos + 1))"""


@query(_BURST + " SELECT chat, message_id, pos, start AS burst FROM b")
def bursts(spark, sf):
    return segment.bursts(_msg(spark, sf), P)


def _cursor_sql(states: str) -> str:
    return f"""WITH f AS (SELECT chat, min(pos) AS stop FROM v_msg WHERE state IN ({states}) GROUP BY chat),
      l AS (SELECT m.chat, max(m.pos) AS pos FROM v_msg m LEFT JOIN f ON f.chat = m.chat WHERE f.stop IS NULL OR m.pos < f.stop GROUP BY m.chat)
      SELECT m.chat, m.ms, m.ordinal FROM l JOIN v_msg m ON m.chat = l.chat AND m.pos = l.pos"""


@query(_cursor_sql("'pending', 'failed'"))
def view_cursor(spark, sf):
    return segment.prefix_cursor(_msg(spark, sf), ["pending", "failed"])


@query(_cursor_sql("'pending'"))
def analyzed_cursor(spark, sf):
    return segment.prefix_cursor(_msg(spark, sf), ["pending"])


_EDGES = """e AS (SELECT s.chat, s.pos AS source, t.pos AS target, (SELECT count(*) FROM v_msg x WHERE x.chat = s.chat AND x.pos > t.pos AND x.pos < s.pos
      AND NOT x.recalled AND x.sender <> s.sender AND x.sender <> t.sender) >= 3 AS crossed
      FROM v_msg s JOIN v_msg t ON t.chat = s.chat AND t.pos = s.reply_pos AND t.pos < s.pos WHERE NOT s.recalled AND NOT t.recalled)"""


@query(f"WITH {_EDGES} SELECT c.chat, count(e.chat) AS edges, count(*) FILTER (crossed) AS crossed, CASE WHEN count(e.chat) > 0 THEN round(count(*) FILTER (crossed) / count(e.chat)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS ratio FROM (SELECT DISTINCT chat FROM v_msg) c LEFT JOIN e ON e.chat = c.chat GROUP BY c.chat")
def interleave(spark, sf):
    return segment.interleave(_msg(spark, sf))


@query(f"WITH {_EDGES}, g AS (SELECT chat, target, count(*) AS n, count(*) FILTER (crossed) AS x FROM e GROUP BY chat, target) SELECT chat, target, sum(n) OVER w AS edges, sum(x) OVER w AS crossed FROM g WINDOW w AS (PARTITION BY chat ORDER BY target DESC)")
def interleave_suffix(spark, sf):
    return segment.interleave_suffix(_msg(spark, sf))


@query("""WITH l AS (SELECT chat, topic, max(ms) AS last_ms FROM v_msg GROUP BY chat, topic)
    SELECT l.chat, l.topic, min(m.ms) AS closed_ms FROM l JOIN v_msg m ON m.chat = l.chat AND m.ms > l.last_ms + 21600000 GROUP BY l.chat, l.topic""")
def topic_close(spark, sf):
    return segment.topic_close(_msg(spark, sf), P.topic_ttl_ms)


def _rows(spark, sf):
    msg = _msg(spark, sf)
    return topics.burst_starts(msg, segment.bursts(msg, P)), msg


_ROWS = _BURST + """, r AS (SELECT m.*, b.start AS burst, f.ms AS at_ms, f.ordinal AS at_ordinal FROM v_msg m JOIN b ON b.message_id = m.message_id
      JOIN v_msg f ON f.chat = b.chat AND f.pos = b.start),
    re AS (SELECT r.chat, r.burst, r.message_id, t.topic FROM r JOIN v_msg t ON t.chat = r.chat AND t.pos = r.reply_pos WHERE NOT r.recalled AND (t.ms, t.ordinal) < (r.at_ms, r.at_ordinal)),
    me AS (SELECT DISTINCT r.chat, r.burst, r.message_id, t.topic FROM r JOIN v_msg t ON t.chat = r.chat AND t.sender = r.mention WHERE NOT r.recalled AND NOT t.recalled AND (t.ms, t.ordinal) < (r.at_ms, r.at_ordinal)),
    ed AS (SELECT chat, burst, topic, least(count(*), 3) AS edges FROM (SELECT * FROM re UNION SELECT * FROM me) GROUP BY chat, burst, topic)"""


@query(_ROWS + " SELECT * FROM re")
def reply_edges(spark, sf):
    return topics.reply_edges(*_rows(spark, sf))


@query(_ROWS + " SELECT chat, burst, topic, count(*) AS mentions FROM me GROUP BY chat, burst, topic")
def mention_edges(spark, sf):
    return topics.mention_edges(*_rows(spark, sf)).groupBy("chat", "burst", "topic").agg(F.count("*").alias("mentions"))


@query(_ROWS + " SELECT * FROM ed")
def burst_topic_edges(spark, sf):
    return topics.burst_topic_edges(*_rows(spark, sf))


_ASOF = """, st AS (SELECT DISTINCT chat, burst, at_ms, at_ordinal FROM r), ac AS (
      SELECT st.chat, st.burst, st.at_ms, m.topic, max(m.ms) AS ms FROM st JOIN v_msg m ON m.chat = st.chat AND NOT m.recalled AND (m.ms, m.ordinal) < (st.at_ms, st.at_ordinal)
        AND st.at_ms - m.ms <= 21600000 GROUP BY ALL)"""


@query(_ROWS + _ASOF + " SELECT chat, burst, topic, ms FROM ac")
def asof_topic_activity(spark, sf):
    rows, msg = _rows(spark, sf)
    starts = rows.select("chat", "burst", "at_ms", "at_ordinal").distinct()
    return segment.asof_activity(starts.drop("burst"), msg, P.topic_ttl_ms).join(starts, ["chat", "at_ms", "at_ordinal"]).select("chat", "burst", "topic", "ms")


@query(_ROWS + _ASOF + """, sc AS (SELECT ac.*, round(0.3 * coalesce(edges, 0) / 3.0 - 0.1 * ((at_ms - ms) / 21600000.0), 9)::DOUBLE AS score FROM ac LEFT JOIN ed USING (chat, burst, topic)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY chat, burst ORDER BY score DESC, ms DESC, topic) AS rank, count(*) OVER (PARTITION BY chat, burst) AS n FROM sc)
    SELECT chat, burst, topic, rank, score FROM rk WHERE n <= 40 OR rank <= 5""")
def topic_candidates(spark, sf):
    return topics.topic_candidates(*_rows(spark, sf), P)


@query(_ROWS + """, o AS (SELECT r.chat, r.burst, t.topic FROM r LEFT JOIN v_msg t ON t.chat = r.chat AND t.pos = r.reply_pos WHERE NOT r.recalled AND r.reply_pos < r.burst)
    SELECT chat, burst, min(topic) AS topic FROM o GROUP BY chat, burst HAVING count(*) = count(topic) AND count(DISTINCT topic) = 1""")
def rule_reply(spark, sf):
    return topics.rule_reply(*_rows(spark, sf))


_STATES = """, ts AS (SELECT chat, topic, CASE min(ordinal) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'closed' ELSE 'merged' END AS state, CASE WHEN min(ordinal) % 3 = 1 THEN (min(ms) + max(ms)) // 2 END AS closed_ms FROM v_msg GROUP BY chat, topic),
    en AS (SELECT chat, burst, max(ms) AS end_ms FROM r WHERE NOT recalled GROUP BY chat, burst), tk AS (SELECT ac.* FROM ac JOIN en USING (chat, burst) LEFT JOIN ts USING (chat, topic) WHERE state = 'active' OR state = 'closed' AND end_ms < closed_ms)"""


def _states(msg):
    """States of topics: of three, one is active, one was closed half-way through its span, one is merged; so that half of a closed topic's bursts come late."""
    each = msg.groupBy("chat", "topic").agg((F.min("ordinal") % 3).alias("k"), F.floor((F.min("ms") + F.max("ms")) / 2).alias("half"))
    state = F.when(F.col("k") == 0, "active").when(F.col("k") == 1, "closed").otherwise("merged")
    return each.select("chat", "topic", state.alias("state"), F.when(F.col("k") == 1, F.col("half")).alias("closed_ms"))


@query(_ROWS + _ASOF + _STATES + """, sc AS (SELECT tk.*, round(0.3 * coalesce(edges, 0) / 3.0 - 0.1 * ((at_ms - ms) / 21600000.0), 9)::DOUBLE AS score FROM tk LEFT JOIN ed USING (chat, burst, topic)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY chat, burst ORDER BY score DESC, ms DESC, topic) AS rank, count(*) OVER (PARTITION BY chat, burst) AS n FROM sc)
    SELECT chat, burst, topic, rank, score FROM rk WHERE n <= 40 OR rank <= 5""")
def late_candidates(spark, sf):
    """Candidates among topics that are active, or closed after the burst."""
    rows, msg = _rows(spark, sf)
    return topics.topic_candidates(rows, msg, P, _states(msg))


@query(_ROWS + _ASOF + _STATES + """, o AS (SELECT r.chat, r.burst, t.topic FROM r LEFT JOIN v_msg t ON t.chat = r.chat AND t.pos = r.reply_pos WHERE NOT r.recalled AND r.reply_pos < r.burst),
    f AS (SELECT chat, burst, min(topic) AS topic FROM o GROUP BY chat, burst HAVING count(*) = count(topic) AND count(DISTINCT topic) = 1)
    SELECT f.* FROM f SEMI JOIN tk USING (chat, burst, topic)""")
def late_rule_reply(spark, sf):
    rows, msg = _rows(spark, sf)
    return topics.rule_reply(rows, msg, P, _states(msg))


_PAIRS = """p AS (SELECT s.chat, least(s.topic, t.topic) AS a, greatest(s.topic, t.topic) AS b, s.message_id FROM v_msg s JOIN v_msg t ON t.chat = s.chat AND t.pos = s.reply_pos AND t.pos < s.pos
      WHERE NOT s.recalled AND NOT t.recalled AND s.topic <> t.topic)"""


@query(f"WITH {_PAIRS} SELECT * FROM p")
def merge_pairs(spark, sf):
    return topics.merge_pairs(_msg(spark, sf))


@query(f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY chat, a, b ORDER BY message_id) AS k FROM p) SELECT chat, a, b, count(*) AS support, string_agg(message_id, ',' ORDER BY message_id) FILTER (k <= 3) AS shown FROM k GROUP BY chat, a, b HAVING count(*) >= 2")
def merge_candidates(spark, sf):
    return topics.merge_candidates(_msg(spark, sf))


@query(f"""WITH {_PAIRS}, q AS (SELECT p.*, ms < 1705500000000 AS old FROM p JOIN v_msg USING (chat, message_id)), k AS (SELECT *, row_number() OVER (PARTITION BY chat, a, b ORDER BY old, message_id) AS k FROM q)
    SELECT chat, a, b, count(*) AS support, string_agg(message_id, ',' ORDER BY k) FILTER (k <= 3) AS shown FROM k GROUP BY chat, a, b HAVING count(*) >= 2 AND bool_or(NOT old)""")
def merge_candidates_scoped(spark, sf):
    """Pairs with a reply in the second half of January 2024."""
    return topics.merge_candidates(_msg(spark, sf), since_ms=1_705_500_000_000)


@query("SELECT DISTINCT chat, topic FROM v_msg EXCEPT SELECT chat, topic FROM v_msg WHERE state IN ('pending', 'failed')")
def settled_topics(spark, sf):
    return topics.settled_topics(_msg(spark, sf))


@query("SELECT chat, topic, count(*) AS messages, min(ms) AS first_ms, max(ms) AS last_ms FROM v_msg GROUP BY chat, topic")
def topic_extent(spark, sf):
    return topics.topic_extent(_msg(spark, sf))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY chat, topic ORDER BY ms DESC, ordinal DESC) AS k FROM v_msg WHERE NOT recalled AND state <> 'pending')
    SELECT chat, topic, message_id, 'c' || row_number() OVER (PARTITION BY chat, topic ORDER BY ms, ordinal) AS ref FROM n WHERE k <= 5""")
def context_rows(spark, sf):
    return topics.context_rows(_msg(spark, sf))


@query(rf"""WITH m AS (SELECT *, NOT recalled AND NOT is_system AS shown, regexp_matches({_TEXT}, '[\p{{L}}\p{{N}}]') AS said FROM v_msg)
    SELECT chat, min(ms) AS start_ms, max(ms) AS end_ms, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (shown) AS messages,
      count(*) FILTER (shown AND said) AS meaningful, count(DISTINCT sender) FILTER (shown) AS participants FROM m GROUP BY chat""")
def overview_header(spark, sf):
    return overview.overview_header(_msg(spark, sf))


@query(rf"SELECT message_id, CASE WHEN regexp_matches({_TEXT}, '[\p{{L}}\p{{N}}]') THEN {_TEXT} END AS said FROM v_msg")
def meaningful_text(spark, sf):
    return _msg(spark, sf).select("message_id", overview.meaningful_text(F.col("text")).alias("said"))


@query(r"""WITH l AS (SELECT DISTINCT chat, ms, ordinal, message_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\s<>"''，。；！？）】」』]*')), '[.,;)\]]+$', '') AS link FROM v_msg WHERE NOT recalled)
    SELECT chat, link, arg_min(message_id, (ms, ordinal)) AS message_id, count(*) AS seen FROM l WHERE strlen(link) > 8 GROUP BY chat, link""")
def resources(spark, sf):
    return overview.resources(_msg(spark, sf))


@query("SELECT chat, message_id, CASE WHEN mention = 'all' THEN '@全体成员' ELSE '直接 @我' END AS reason FROM v_msg WHERE NOT recalled AND mention IN ('all', 'u7')")
def mention_me(spark, sf):
    return overview.mention_me(_msg(spark, sf), "u7")


@query("SELECT chat, message_id, ms, topic FROM v_msg WHERE ms >= (SELECT min(ms) + 3600000 FROM v_msg) AND ms < (SELECT min(ms) + 86400000 FROM v_msg)")
def messages_range(spark, sf):
    msg = _msg(spark, sf)
    start = msg.agg(F.min("ms")).first()[0]
    return overview.messages_range(msg, start + 3_600_000, start + 86_400_000)


@query("WITH s AS (SELECT chat, message_id, sum(len(text) + 256) OVER (PARTITION BY chat ORDER BY ms DESC, ordinal DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM v_msg) SELECT * FROM s WHERE used <= 96000")
def suffix_truncate(spark, sf):
    return overview.suffix_within(_msg(spark, sf), 96_000)


@query("SELECT chat, (pos - 1) // 40 AS batch, count(*) AS messages, min(ms) AS from_ms FROM v_msg GROUP BY ALL")
def batch_40(spark, sf):
    return overview.batches(_msg(spark, sf))


@query("SELECT chat, count(*) AS messages, count(*) FILTER (state = 'pending' AND NOT recalled) AS pending, count(DISTINCT topic) FILTER (state = 'pending' AND NOT recalled) AS dirty_topics, max(ms) AS last_ms FROM v_msg GROUP BY chat")
def work_plan(spark, sf):
    todo = (F.col("state") == "pending") & ~F.col("recalled")
    return _msg(spark, sf).groupBy("chat").agg(F.count("*").alias("messages"), F.count_if(todo).alias("pending"), F.countDistinct(F.when(todo, F.col("topic"))).alias("dirty_topics"), F.max("ms").alias("last_ms"))


@query("SELECT message_id, chat, ms, state FROM v_msg WHERE NOT recalled AND state IN ('pending', 'failed')")
def eligible_messages(spark, sf):
    return _msg(spark, sf).where("not recalled and state in ('pending', 'failed')").select("message_id", "chat", "ms", "state")


@query("SELECT s.message_id, t.message_id AS target FROM v_msg s LEFT JOIN v_msg t ON t.chat = s.chat AND t.pos = s.reply_pos AND NOT t.recalled WHERE s.reply_pos IS NOT NULL")
def reply_resolve(spark, sf):
    msg = _msg(spark, sf)
    target = msg.where("not recalled").select("chat", F.col("pos").alias("reply_pos"), F.col("message_id").alias("target"))
    return msg.where("reply_pos is not null").join(target, ["chat", "reply_pos"], "left").select("message_id", "target")


@query("SELECT chat, sender, min(ms) AS first_ms, max(ms) AS last_ms FROM v_msg GROUP BY chat, sender")
def alias_history(spark, sf):
    return _msg(spark, sf).groupBy("chat", "sender").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query("SELECT sender, min(ms) AS first_ms FROM v_msg GROUP BY sender")
def person_first_seen(spark, sf):
    return _msg(spark, sf).groupBy("sender").agg(F.min("ms").alias("first_ms"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY chat, sender, text, ms // 60000 ORDER BY ordinal) AS k, bool_or(recalled) OVER (PARTITION BY chat, sender, text, ms // 60000) AS gone FROM v_msg)
    SELECT chat, count(*) AS seen, count(*) FILTER (k = 1) AS inserted, count(*) FILTER (k > 1) AS duplicates, count(*) FILTER (k = 1 AND gone) AS recalled FROM f GROUP BY ROLLUP (chat)""")
def import_counts(spark, sf):
    """Rows with one (chat, sender, text, minute) stand for copies of one message; a later recall counts for all."""
    same = Window.partitionBy("chat", "sender", "text", F.floor(F.col("ms") / 60_000))
    rows = _msg(spark, sf).withColumns({"k": F.row_number().over(same.orderBy("ordinal")), "gone": F.bool_or("recalled").over(same)})
    return rows.rollup("chat").agg(F.count("*").alias("seen"), F.count_if(F.col("k") == 1).alias("inserted"), F.count_if(F.col("k") > 1).alias("duplicates"), F.count_if((F.col("k") == 1) & F.col("gone")).alias("recalled"))


_FAIL = r"""ev AS (SELECT e.*, CASE WHEN m.text IS NULL THEN 'message_not_found' WHEN m.recalled THEN 'recalled' WHEN len(regexp_replace(e.quote, '\s', '', 'g')) < 3 THEN 'quote_too_short'
      WHEN NOT contains(regexp_replace(m.text, '\s', '', 'g'), regexp_replace(e.quote, '\s', '', 'g')) THEN 'quote_not_found' END AS failure, m.text FROM v_evidence e LEFT JOIN v_msg m ON m.message_id = e.message_id)"""
_VER = f"""{_FAIL}, ve AS (SELECT i.insight_id, i.kind, i.bound_date, count(*) FILTER (e.insight_id IS NOT NULL AND failure IS NULL) AS ok, count(failure) AS bad,
      CASE WHEN count(e.insight_id) = 0 THEN 'no_evidence' ELSE coalesce(string_agg(failure, ',' ORDER BY idx, failure, message_id), '') END AS failures FROM v_insight i LEFT JOIN ev e ON e.insight_id = i.insight_id GROUP BY ALL)"""


@query(f"WITH {_VER} SELECT insight_id, CASE WHEN failures = '' THEN 'verified' WHEN kind = 'topic_summary' AND bound_date IS NULL AND ok > 0 THEN 'unverified' ELSE 'rejected' END AS status, ok, bad, failures FROM ve")
def verify_evidence(spark, sf):
    return verify.verify_evidence(view(spark, sf, "v_insight"), view(spark, sf, "v_evidence"), _msg(spark, sf))


@query(f"WITH {_FAIL} SELECT insight_id, idx, message_id, strpos(text, regexp_replace(quote, '\\s', '', 'g')) - 1 AS at, strpos(text, regexp_replace(quote, '\\s', '', 'g')) - 1 + len(regexp_replace(quote, '\\s', '', 'g')) AS until FROM ev WHERE failure IS NULL")
def evidence_view(spark, sf):
    return verify.evidence_view(view(spark, sf, "v_evidence"), _msg(spark, sf))


_PRIO = """CASE WHEN bound_date IS NOT NULL AND kind <> 'topic_summary' THEN 'P0' WHEN kind = 'mention_me' THEN CASE WHEN p_action BETWEEN 0.5 AND 1 THEN 'P0' ELSE 'P1' END
      WHEN kind = 'todo' THEN CASE assignee WHEN 'me' THEN 'P0' WHEN 'all' THEN 'P0' WHEN 'unknown' THEN 'P1' ELSE 'P2' END WHEN kind IN ('announcement', 'decision') THEN 'P1'
      WHEN p_chitchat BETWEEN 0.5 AND 1 THEN 'P3' ELSE 'P2' END"""
_DAYS = f"CASE WHEN bound_sec IS NOT NULL THEN (epoch(bound_date) + bound_sec - {NOW_S}) / 86400.0 ELSE (bound_date - DATE '2000-01-01')::DOUBLE END"
_PRIOR = f"""((CASE WHEN {_DAYS} >= 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + {_DAYS}) ELSE 0 END) + 0.8::DOUBLE * (CASE WHEN p_action BETWEEN 0 AND 1 THEN p_action ELSE 0.5 END)::DOUBLE
      + 0.5::DOUBLE * (CASE WHEN urgency BETWEEN 0 AND 2 THEN urgency / 2.0 ELSE 0 END)::DOUBLE + 0.3::DOUBLE * exp(-(o_orderkey % 30)::DOUBLE))"""


def _scored(spark, sf):
    """Insights with priority and score."""
    ins = view(spark, sf, "v_insight")
    prior = rank.rank_prior(NOW_S, F.col("p_action").cast("double"), F.col("urgency").cast("double"), F.lit(NOW_S) - F.col("o_orderkey") % 30 * 86_400)
    return ins.withColumns({"priority": rank.priority(), "score": F.round(prior.cast("double"), 4)})


@query(f"SELECT insight_id, {_PRIO} AS priority FROM v_insight")
def priority(spark, sf):
    return _scored(spark, sf).select("insight_id", "priority")


@query(f"SELECT insight_id, round({_PRIOR}::FLOAT::DOUBLE, 4) AS score FROM v_insight")
def rank_prior(spark, sf):
    return _scored(spark, sf).select("insight_id", "score")


_RANK = f"""sc AS (SELECT *, {_PRIO} AS priority, round({_PRIOR}::FLOAT::DOUBLE, 4) AS score FROM v_insight),
    rk AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY priority, score DESC, insight_id) AS place FROM sc)"""


@query(f"WITH {_RANK} SELECT topic_id, insight_id, priority, score, place FROM rk")
def inbox_rank(spark, sf):
    return rank.inbox_rank(_scored(spark, sf)).select("topic_id", "insight_id", "priority", "score", "place")


@query(f"WITH {_RANK} SELECT topic_id, count(*) AS items, arg_min(priority, place) AS priority, string_agg(insight_id, ',' ORDER BY place) FILTER (place <= 3) AS first FROM rk GROUP BY topic_id")
def priority_topics(spark, sf):
    return rank.topic_digest(rank.inbox_rank(_scored(spark, sf)))


_OPEN = f"(CASE WHEN bound_sec IS NOT NULL THEN epoch(bound_date) + bound_sec >= {NOW_S} ELSE bound_date >= DATE '2000-01-01' END)"


@query(f"WITH {_RANK} SELECT topic_id, insight_id, priority, status FROM rk WHERE status <> 'rejected' AND lifecycle <> 'resolved' AND (priority = 'P0' OR priority = 'P1' AND coalesce({_OPEN}, true))")
def inbox(spark, sf):
    rows = rank.inbox_rank(_scored(spark, sf)).where("status <> 'rejected' and lifecycle <> 'resolved'")
    keep = (F.col("priority") == "P0") | ((F.col("priority") == "P1") & F.coalesce(rank.deadline_open(NOW_S), F.lit(True)))
    return rows.where(keep).select("topic_id", "insight_id", "priority", "status")


@query(f"""WITH {_RANK}, {_VER}, nw AS (SELECT insight_id, CASE WHEN failures = '' THEN 'verified' WHEN kind = 'topic_summary' AND bound_date IS NULL AND ok > 0 THEN 'unverified' ELSE 'rejected' END AS now FROM ve)
    SELECT topic_id, insight_id, priority, CASE WHEN status = 'rejected' OR now = 'rejected' THEN 'rejected' WHEN status = 'unverified' OR now = 'unverified' THEN 'unverified' ELSE 'verified' END AS status,
      status <> 'rejected' AND now <> 'rejected' AS shown
    FROM rk JOIN nw USING (insight_id) WHERE lifecycle <> 'resolved' AND (priority = 'P0' OR priority = 'P1' AND coalesce({_OPEN}, true))""")
def inbox_recheck(spark, sf):
    """The inbox with evidence checked again when read: status is the worse of the stored one and the one now."""
    now = verify_evidence(spark, sf).select("insight_id", F.col("status").alias("now"))
    rows = _scored(spark, sf).where("lifecycle <> 'resolved'").join(now, "insight_id")
    keep = (F.col("priority") == "P0") | ((F.col("priority") == "P1") & F.coalesce(rank.deadline_open(NOW_S), F.lit(True)))
    status = rank.status_merge(F.col("status"), F.col("now"))
    return rows.where(keep).select("topic_id", "insight_id", "priority", status.alias("status"), (status != "rejected").alias("shown"))


@query(f"WITH {_RANK} SELECT topic_id, count(*) FILTER (priority = 'P0' AND status <> 'rejected') AS p0, count(*) FILTER (priority = 'P1' AND status <> 'rejected') AS p1, count(*) FILTER (priority = 'P2' AND status <> 'rejected') AS p2, count(*) FILTER (priority = 'P3' AND status <> 'rejected') AS p3, count(*) FILTER (status = 'rejected') AS rejected FROM rk GROUP BY topic_id")
def inbox_counts(spark, sf):
    ok = F.col("status") != "rejected"
    return _scored(spark, sf).groupBy("topic_id").agg(*[F.count_if((F.col("priority") == f"P{i}") & ok).alias(f"p{i}") for i in range(4)], F.count_if(~ok).alias("rejected"))


@query(f"SELECT insight_id, {_OPEN} AS open FROM v_insight WHERE bound_date IS NOT NULL")
def deadline_open(spark, sf):
    return view(spark, sf, "v_insight").where("bound_date is not null").select("insight_id", rank.deadline_open(NOW_S).alias("open"))


@query(f"""SELECT insight_id, CASE WHEN NOT by_rule OR relation NOT IN ('before', 'at') OR bound_date IS NULL THEN 'uncertain'
    WHEN CASE WHEN bound_sec IS NOT NULL THEN CASE WHEN relation = 'before' THEN epoch(bound_date) + bound_sec <= {NOW_S} ELSE epoch(bound_date) + bound_sec < {NOW_S} END ELSE bound_date < DATE '2000-01-01' END THEN 'overdue' ELSE 'upcoming' END AS deadline FROM v_insight""")
def deadline_status(spark, sf):
    return view(spark, sf, "v_insight").select("insight_id", rank.deadline_status(NOW_S).alias("deadline"))


@query("SELECT insight_id, CASE WHEN status = 'rejected' OR o_custkey % 3 = 2 THEN 'rejected' WHEN status = 'unverified' OR o_custkey % 3 = 1 THEN 'unverified' ELSE 'verified' END AS status FROM v_insight")
def status_merge(spark, sf):
    now = F.element_at(F.array(F.lit("verified"), F.lit("unverified"), F.lit("rejected")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return view(spark, sf, "v_insight").select("insight_id", rank.status_merge(F.col("status"), now).alias("status"))


_FEATURE = """f AS (SELECT insight_id, unnest(['kind:' || kind, 'topic:' || topic_id, 'deadline:' || (bound_date IS NOT NULL)::VARCHAR]) AS feature, o_totalprice / 1000000 AS prior, o_orderkey FROM v_insight)"""


def _features(spark, sf):
    made = F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("topic:"), F.col("topic_id").cast("string")), F.concat(F.lit("deadline:"), F.col("bound_date").isNotNull().cast("string")))
    return view(spark, sf, "v_insight").select("insight_id", F.explode(made).alias("feature"), (F.col("o_totalprice") / 1000000).alias("prior"), "o_orderkey")


def _votes(spark, sf, every: int = 100):
    """One insight in every (a hundred) has a vote, one in a thousand marks a decay of its features."""
    f = _features(spark, sf).where(F.col("o_orderkey") % every == 0)
    label = F.when(F.col("o_orderkey") % 1000 == 0, 0).when(F.col("o_orderkey") % 300 == 0, -1).otherwise(1)
    return f.select("feature", F.col("o_orderkey").alias("at"), F.col("insight_id").alias("tie"), label.alias("label"))


@query(f"WITH {_FEATURE} SELECT insight_id, feature FROM f")
def insight_features(spark, sf):
    return _features(spark, sf).select("insight_id", "feature")


_WEIGHTS = f"""WITH RECURSIVE {_FEATURE}, vt AS (SELECT feature, CASE WHEN o_orderkey % 1000 = 0 THEN 0 WHEN o_orderkey % 300 = 0 THEN -1 ELSE 1 END AS label,
      row_number() OVER (PARTITION BY feature ORDER BY o_orderkey, insight_id) AS k FROM f WHERE o_orderkey % 100 = 0),
    wt(feature, k, w) AS (SELECT DISTINCT feature, 0::BIGINT, 0.0::DOUBLE FROM vt UNION ALL
      SELECT wt.feature, vt.k, CASE WHEN label = 0 THEN w * 0.95::DOUBLE ELSE greatest(-0.5::DOUBLE, least(0.5::DOUBLE, w * 0.95::DOUBLE + 0.2::DOUBLE * label)) END FROM wt JOIN vt ON vt.feature = wt.feature AND vt.k = wt.k + 1),
    pw AS (SELECT feature, round(arg_max(w, k), 9) AS weight, max(k) AS events FROM wt GROUP BY feature)"""


@query(_WEIGHTS + " SELECT * FROM pw")
def preference_weights(spark, sf):
    return rank.preference_weights(_votes(spark, sf))


@query(_WEIGHTS + " SELECT insight_id, round(first(prior) + avg(coalesce(weight, 0)), 9) AS score FROM f LEFT JOIN pw USING (feature) GROUP BY insight_id")
def personal_score(spark, sf):
    return rank.personal_score(_features(spark, sf), rank.preference_weights(_votes(spark, sf)).select("feature", "weight"))


@query()
def preference_weights_all(spark, sf):
    """Every insight has a vote. No SQL: its recursion takes a step an event."""
    return rank.preference_weights(_votes(spark, sf, every=1))


@query()
def personal_score_all(spark, sf):
    return rank.personal_score(_features(spark, sf), rank.preference_weights(_votes(spark, sf, every=1)).select("feature", "weight"))


@query("""SELECT l_returnflag AS stage, l_linestatus AS provider, n_name AS model, count(*) AS calls, sum(l_quantity) AS tokens, round(sum(l_extendedprice), 2) AS cost
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, n_name), (l_returnflag), ())""")
def usage_rollup(spark, sf):
    rows = view(spark, sf, "lineitem").join(view(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(view(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.select(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("provider"), F.col("n_name").alias("model"), "l_quantity", "l_extendedprice")
    each = rows.groupingSets([["stage", "provider", "model"], ["stage"], []], "stage", "provider", "model")
    return each.agg(F.count("*").alias("calls"), F.sum("l_quantity").alias("tokens"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("events", "orders", "lineitem", "customer", "documents")))
def table_counts(spark, sf):
    out = None
    for t in ("events", "orders", "lineitem", "customer", "documents"):
        one = view(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT model, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5) AS predicted, count(*) FILTER (y = 1) AS gold,
    round(count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE / nullif(count(*) FILTER (p >= 0.5), 0), 6) AS precision, round(count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 6) AS recall,
    round(2 * count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE / nullif(count(*) FILTER (p >= 0.5) + count(*) FILTER (y = 1), 0), 6) AS f1 FROM v_prob GROUP BY model""")
def prf(spark, sf):
    return evaluate.prf(view(spark, sf, "v_prob"), "model")


@query("""WITH b AS (SELECT model, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(sum(p) - sum(y)) AS gap, sum((p - y) * (p - y)) AS sq FROM v_prob GROUP BY ALL)
    SELECT model, sum(n)::BIGINT AS n, round(sum(gap) / sum(n), 6)::DOUBLE AS ece, round(sum(sq) / sum(n), 6)::DOUBLE AS brier FROM b GROUP BY model""")
def calibration(spark, sf):
    return evaluate.calibration(view(spark, sf, "v_prob"), "model")


_CELLS = "c AS (SELECT p, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY p) AS np, sum(count(*)) OVER (PARTITION BY g) AS ng FROM v_cluster GROUP BY p, g)"


@query(f"WITH {_CELLS} SELECT count(*) FILTER (n = np AND n = ng) AS exact, count(DISTINCT p) AS predicted, count(DISTINCT g) AS gold, round(2.0 * count(*) FILTER (n = np AND n = ng) / (count(DISTINCT p) + count(DISTINCT g)), 6) AS f1 FROM c")
def thread_exact_f1(spark, sf):
    return evaluate.thread_exact_f1(view(spark, sf, "v_cluster"))


@query(f"""WITH {_CELLS}, s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS c, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM v_cluster GROUP BY p)) AS a,
    (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM v_cluster GROUP BY g)) AS b, (SELECT count(*) * (count(*) - 1) / 2.0 FROM v_cluster) AS t)
    SELECT round((c - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM s""")
def ari(spark, sf):
    return evaluate.ari(view(spark, sf, "v_cluster"))


@query(f"""WITH {_CELLS}, t AS (SELECT count(*)::DOUBLE AS t FROM v_cluster), hp AS (SELECT sum(-n / t * ln(n / t)) AS h FROM (SELECT p, count(*) AS n FROM v_cluster GROUP BY p), t),
    hg AS (SELECT sum(-n / t * ln(n / t)) AS h FROM (SELECT g, count(*) AS n FROM v_cluster GROUP BY g), t), mi AS (SELECT sum(n / t * ln(n * t / (np * ng))) AS m FROM c, t)
    SELECT round(m / ((hp.h + hg.h) / 2), 6) AS nmi FROM mi, hp, hg""")
def nmi(spark, sf):
    return evaluate.nmi(view(spark, sf, "v_cluster"))


_PLACED = """pl AS (SELECT c_mktsegment AS run, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS place,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS rel FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _placed(spark, sf):
    rows = view(spark, sf, "orders").join(view(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    first = F.substring("o_orderpriority", 1, 1)
    return rows.select(F.col("c_mktsegment").alias("run"), place.alias("place"), F.when(first == "1", 3).when(first == "2", 2).when(first == "3", 1).otherwise(0).alias("rel"))


@query(f"""WITH {_PLACED}, b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rel DESC, place) AS best FROM pl)
    SELECT run, round(sum(CASE WHEN place <= 10 THEN (pow(2.0, rel) - 1) / log2(place + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 10 THEN (pow(2.0, rel) - 1) / log2(best + 1) ELSE 0 END), 0), 6) AS ndcg FROM b GROUP BY run""")
def ndcg(spark, sf):
    return evaluate.ndcg(_placed(spark, sf), 10, "run")


@query(f"WITH {_PLACED} SELECT run, count(*) FILTER (rel = 3 AND place <= 100) AS found, count(*) FILTER (rel = 3) AS gold, round(count(*) FILTER (rel = 3 AND place <= 100)::DOUBLE / nullif(count(*) FILTER (rel = 3), 0), 6) AS recall FROM pl GROUP BY run")
def p0_recall(spark, sf):
    return evaluate.top_recall(_placed(spark, sf), 100, 3, "run")


#: Phrases of all kinds, laid over the orders' dates.
PHRASES = ["周一前", "下周四之前", "明早7点", "今晚9点半", "大后天上午10点之前", "5天内", "12月24日", "周日", "本周二", "28号", "2月29日", "十一点四十分", "ddl:周六", "截至周四", "26点", "再说", "十天后", "下午六点"]


def _phrases(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % len(PHRASES) + 1).cast("int"))
    return view(spark, sf, "orders").select(raw.alias("raw"), F.col("o_orderdate").cast("date").alias("local_date"))


@query()
def deadline_normalize(spark, sf):
    from .functions.deadline import normalize

    rows = _phrases(spark, sf)
    return rows.groupBy("raw", "local_date").agg(F.count("*").alias("n")).transform(normalize)


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 16 <> 0 THEN o_orderkey - 1 END AS parent FROM orders),
    q AS (SELECT p.node, CASE WHEN e.node IS NULL THEN NULL ELSE p.parent END AS parent FROM p LEFT JOIN p e ON e.node = p.parent),
    r(node, root) AS (SELECT node, node FROM q WHERE parent IS NULL UNION ALL SELECT q.node, r.root FROM q JOIN r ON q.parent = r.node)
    SELECT * FROM r""")
def alias_root(spark, sf):
    from .operators.graph import alias_root as roots

    p = view(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 16 != 0, F.col("o_orderkey") - 1).alias("parent"))
    known = p.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    return roots(p.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent")))


@query()
def merge_closure(spark, sf):
    """Where each topic ends up when all settled pairs with enough support merge. Supports add in rounds: no SQL, tests hold it against single merges."""
    from .operators.graph import merge_closure as closure

    return closure(topics.merge_supports(_msg(spark, sf)).select("a", "b", "support"))


@query()
def merge_closure_scoped(spark, sf):
    """The same with rejected pairs (every fifth pair of topics with a reply between them) and a scope (the second half of the month). No SQL, as above."""
    from .operators.graph import merge_closure as closure

    msg = _msg(spark, sf)
    first, last = _middle(spark, sf)
    supports = topics.merge_supports(msg, (first + last) // 2)
    rejected = topics.merge_pairs(msg).select("a", "b").distinct().where(F.crc32(F.concat("a", "b").cast("binary")) % 5 == 0)
    return closure(supports.select("a", "b", "support", "in_scope"), rejected)


@query()
def match_greedy(spark, sf):
    """Parts against suppliers as predictions and gold items, overlap = lines in common, in runs by line number."""
    from .operators.graph import match_greedy as greedy

    li = view(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("run"), F.col("l_partkey").alias("pred"), F.col("l_suppkey").alias("gold")).agg(F.count("*").alias("overlap"))
    return greedy(li.withColumn("rank", F.col("pred")))


def _middle(spark, sf) -> tuple[int, int]:
    """From a quarter to three quarters of the time that the messages span."""
    r = _msg(spark, sf).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
    return r.lo + (r.hi - r.lo) // 4, r.lo + (r.hi - r.lo) * 3 // 4


_MIDDLE = "b AS (SELECT min(ms) + (max(ms) - min(ms)) // 4 AS lo, min(ms) + (max(ms) - min(ms)) * 3 // 4 AS hi FROM v_event)"
_SEEN = f"{_MIDDLE}, seen AS (SELECT r.*, b.lo FROM v_relation r, b WHERE source_ms < hi AND (target_id IS NULL OR target_ms < hi))"


@query(f"WITH {_SEEN} SELECT rel_id, kind, source_id, target_id FROM seen WHERE coalesce(target_ms, source_ms) >= lo")
def relations_range(spark, sf):
    return relations.relations_range(view(spark, sf, "v_relation"), *_middle(spark, sf)).select("rel_id", "kind", "source_id", "target_id")


@query(f"""WITH {_SEEN}, a AS (SELECT source_id, quote, count(*) AS n, bool_or(completeness = 'full') AS f FROM seen WHERE valid AND kind = 'answers' GROUP BY ALL)
    SELECT s.rel_id, s.source_id, s.quote, CASE WHEN f THEN 'answered' WHEN n > 0 THEN 'partially_answered' ELSE 'pending' END AS status, coalesce(n, 0) AS answers
    FROM seen s LEFT JOIN a ON a.source_id = s.source_id AND a.quote = s.quote WHERE s.valid AND s.kind = 'question' AND s.source_ms >= s.lo""")
def question_status(spark, sf):
    return relations.question_status(view(spark, sf, "v_relation"), *_middle(spark, sf))


@query("""SELECT topic, rel_id, source_id, quote FROM v_relation q WHERE valid AND kind = 'question' AND NOT EXISTS (
    SELECT 1 FROM v_relation a WHERE a.valid AND a.kind = 'answers' AND a.completeness = 'full' AND a.topic = q.topic AND a.source_id = q.source_id AND a.quote = q.quote)""")
def open_questions(spark, sf):
    return relations.open_questions(view(spark, sf, "v_relation"))


@query(f"""WITH {_MIDDLE}, d AS (SELECT DISTINCT target_id FROM v_relation WHERE kind = 'answers')
    SELECT chat, count(*) AS messages, count(target_id) AS analysed, count(*) - count(target_id) AS uncovered
    FROM v_msg m CROSS JOIN b LEFT JOIN d ON d.target_id = m.message_id WHERE ms >= lo AND ms < hi AND NOT recalled GROUP BY chat""")
def relation_coverage(spark, sf):
    analysed = view(spark, sf, "v_relation").where("kind = 'answers'").select(F.col("target_id").alias("message_id"))
    return relations.relation_coverage(_msg(spark, sf), analysed, *_middle(spark, sf))


from . import queries_checks, queries_ingest, queries_requests, queries_streams, queries_strict, queries_views  # noqa: E402, F401  they register their queries
