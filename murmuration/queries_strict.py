"""Queries of strict reading, reconciliation, identities, the render view and what follows a merge."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from .operators import contracts, gold, identity, overview, rank, reconcile, scores, sinks, synthesis, topics, verify
from .plans.storage import fresh_path
from .plans.views import view
from .queries import _PAIRS, _ROWS, _rows
from .registry import query


def _msg(spark, sf):
    return view(spark, sf, "v_msg")


@query("""WITH d AS (SELECT doc_id AS line, doc_id % 13 AS k FROM documents), r(k, rule) AS (VALUES (1, 'field is missing'), (2, 'deadline text'), (3, 'deadline date'), (4, 'deadline date'), (6, 'unknown field'),
      (7, 'unknown field of deadline'), (8, 'anchors'), (9, 'anchors'), (10, 'item id'), (11, 'not an object'), (12, 'item id is repeated'))
    SELECT line, rule FROM d JOIN r USING (k)""")
def gold_item_check(spark, sf):
    """Items as JSON lines; an explicit null deadline is fine, a missing one is not."""
    parts = {"item_id": "concat('\"i', doc_id, '\"')", "kind": "'\"todo\"'", "assignee": "'\"me\"'", "anchors": "concat('[\"', m, '\"]')", "deadline": "'null'", "importance": "'\"P1\"'"}

    def line(**other: str) -> str:
        each = {**parts, **other}
        return "concat('{', " + ", ',', ".join(f"'\"{k}\":', {v}" for k, v in each.items() if v) + ", '}')"

    due = lambda x: "'" + x + "'"
    kinds = {
        1: line(deadline=""), 2: line(deadline=due("{}")), 3: line(deadline=due('{"raw":"soon","relation":"before"}')), 4: line(deadline=due('{"raw":"soon","relation":"before","bound_date":"2026-02-30"}')),
        5: line(deadline=due('{"raw":"soon","relation":"at","bound_date":"2026-02-28"}')), 6: line(mood="'1'"), 7: line(deadline=due('{"raw":"soon","mood":1}')), 8: line(anchors="'[]'"), 9: line(anchors="concat('[\"', m, '\",\"', m, '\"]')"),
        10: line(item_id="doc_id"), 11: "'[1]'", 12: line(item_id="'\"same\"'"),
    }
    made = "CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN {v}" for k, v in kinds.items()) + f" ELSE {line()} END"
    path = fresh_path(spark, "items")
    rows = view(spark, sf, "documents").selectExpr("doc_id", "concat('m_', lpad(lower(hex(doc_id)), 16, '0')) AS m")
    rows.selectExpr(f"concat(doc_id, chr(9), {made}) AS value").write.text(path)
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("bigint").alias("line"), F.expr("substr(value, instr(value, chr(9)) + 1)").alias("raw"))
    return gold.item_problems(lines)


@query("""WITH m AS (SELECT printf('m_%016x', ordinal) AS message_id, ordinal, ordinal % 13 AS k FROM v_msg WHERE NOT recalled), f AS (SELECT * FROM m WHERE ordinal % 31 <> 0)
    SELECT message_id, 'row is missing' AS rule FROM m WHERE ordinal % 31 = 0 UNION ALL SELECT message_id, 'display_text was changed' FROM f WHERE ordinal % 23 = 0 UNION ALL SELECT message_id, 'thread is missing' FROM f WHERE ordinal % 17 = 0
    UNION ALL SELECT message_id, 'todo is not true or false' FROM f WHERE ordinal % 19 = 0 UNION ALL SELECT message_id, 'items are no array' FROM f WHERE k = 0
    UNION ALL SELECT message_id, 'row is no anchor of its item' FROM f WHERE k = 2 UNION ALL SELECT message_id, 'anchor is not in the sheet' FROM f WHERE k = 2
    UNION ALL SELECT message_id, 'item: field is missing' FROM f WHERE k = 3 UNION ALL SELECT message_id, 'item id is repeated' FROM f WHERE k = 4""")
def sheet_strict_check(spark, sf):
    """A sheet of ten columns, filled in and read back, with items; some rows are wrong."""
    msg = _msg(spark, sf).selectExpr("concat('m_', lpad(lower(hex(ordinal)), 16, '0')) AS message_id", "ms AS sent_at", "sender", "sender AS sender_display", "text AS display_text", "recalled", "ordinal", "topic")
    source = gold.sheet(msg)
    item = lambda anchor, end, name="concat('i', ordinal)": f"concat('[{{\"item_id\":\"', {name}, '\",\"kind\":\"todo\",\"assignee\":\"all\",\"anchors\":[\"', {anchor}, '\"],\"importance\":\"P2\"{end}}}]')"
    null = ',"deadline":null'
    items = f"CASE ordinal % 13 WHEN 0 THEN 'x' WHEN 1 THEN {item('message_id', null)} WHEN 2 THEN {item('repeat_id', null)} WHEN 3 THEN {item('message_id', '')} WHEN 4 THEN {item('message_id', null, name='same')} ELSE '[]' END"
    filled = source.join(msg.select("message_id", "ordinal", "topic"), "message_id").where("ordinal % 31 <> 0").withColumns({"repeat_id": F.lit("m_" + "f" * 16), "same": F.lit("same")}).withColumns({
        "display_text": F.expr("IF(ordinal % 23 = 0, concat(display_text, '!'), display_text)"), "thread": F.expr("IF(ordinal % 17 = 0, '', topic)"), "todo": F.expr("IF(ordinal % 19 = 0, 'maybe', IF(ordinal % 2 = 0, 'true', ' false'))"),
        "announcement": F.lit("true"), "items_json": F.expr(items)})
    path = fresh_path(spark, "strict-sheet")
    filled.select(*gold.SHEET).write.option("maxRecordsPerFile", 100_000).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    read = spark.read.schema(", ".join(f"{c} string" for c in gold.SHEET)).option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    return gold.sheet_problems(read, source)


@query(_ROWS + " SELECT chat, burst, message_id, topic FROM me")
def mention_reach(spark, sf):
    """Mentions by one key or the other, some with a placeholder, reach the topics of the person."""
    rows, msg = _rows(spark, sf)
    n = F.regexp_replace("sender", "u", "").cast("bigint")
    people = msg.select("chat", F.col("sender").alias("person"), F.when(n % 17 == 0, "unknown").otherwise(F.col("sender")).alias("uid"), F.regexp_replace("sender", "u", "n").alias("uin")).distinct()
    by = F.col("ordinal") % 3
    mentions = msg.where("mention <> 'all'").select("chat", "message_id", F.lit("user").alias("kind"), F.when(by == 1, "unknown").otherwise(F.col("mention")).alias("uid"), F.when(by > 0, F.regexp_replace("mention", "u", "n")).otherwise("").alias("uin"))
    return identity.mention_reach(rows, mentions, msg, people)


_LISTED = """li AS (SELECT topic_id AS listing, insight_id AS item, kind, 'P' || o_orderkey % 4 AS priority, p_action AS rank, status, bound_date IS NOT NULL AS has_deadline, o_orderkey FROM v_insight),
    pl AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE 1 END, priority, rank DESC, item) AS place FROM li),
    lg AS (SELECT *, lag((priority, -rank, item)) OVER (PARTITION BY listing ORDER BY place) AS b FROM pl),
    ev AS (SELECT e.insight_id, count(*) AS n, count(*) FILTER (m.message_id IS NOT NULL AND e.idx % 5 <> 0) AS f FROM v_evidence e LEFT JOIN (SELECT DISTINCT message_id FROM v_msg) m USING (message_id) GROUP BY e.insight_id)"""


def _listed(spark, sf):
    rows = view(spark, sf, "v_insight").selectExpr("topic_id AS listing", "insight_id AS item", "kind", "concat('P', o_orderkey % 4) AS priority", "CAST(p_action AS DOUBLE) AS rank", "status", "bound_date IS NOT NULL AS has_deadline", "o_orderkey")
    place = F.row_number().over(Window.partitionBy("listing").orderBy(F.when(F.col("o_orderkey") % 40 == 0, 0).otherwise(1), "priority", F.desc("rank"), "item"))
    return rows.withColumn("place", place)


@query(f"""WITH {_LISTED} SELECT DISTINCT listing, NULL::VARCHAR AS item, 'counts' AS rule FROM li WHERE listing % 7 = 0 UNION ALL SELECT DISTINCT listing, NULL, 'rejected count' FROM li WHERE listing % 11 = 0
    UNION ALL SELECT listing, item, 'rank order' FROM lg WHERE b > (priority, -rank, item) UNION ALL SELECT listing, item, 'unverified' FROM li WHERE status = 'unverified' AND (kind <> 'topic_summary' OR has_deadline)
    UNION ALL SELECT listing, item, 'evidence' FROM li LEFT JOIN ev ON ev.insight_id = li.item WHERE status <> 'rejected' AND (coalesce(f, 0) = 0 OR status = 'verified' AND f <> n)""")
def listing_problems(spark, sf):
    listed = _listed(spark, sf)
    told = listed.groupBy("listing", "priority").agg(F.count("*").alias("n")).withColumn("n", F.when((F.col("listing") % 7 == 0) & (F.col("priority") == "P1"), F.col("n") + 1).otherwise(F.col("n")))
    told = told.groupBy("listing").agg(F.map_from_entries(F.collect_list(F.struct("priority", "n"))).alias("counts"))
    gone = listed.groupBy("listing").agg((F.count_if(F.col("status") == "rejected") + F.when(F.col("listing") % 11 == 0, 1).otherwise(0)).alias("rejected"))
    evidence = view(spark, sf, "v_evidence").join(listed.select(F.col("item").alias("insight_id"), "listing"), "insight_id")
    evidence = evidence.select("listing", F.col("insight_id").alias("item"), "message_id", F.when(F.col("idx") % 5 == 0, " ").otherwise(F.col("quote")).alias("quote"))
    return reconcile.listing_problems(told.join(gone, "listing"), listed, evidence, _msg(spark, sf))


@query("""WITH a AS (SELECT topic_id, kind, count(*) AS n FROM v_insight GROUP BY ALL), b AS (SELECT topic_id, kind, count(*) FILTER (o_orderkey % 9 <> 0) + count(*) FILTER (o_orderkey % 10 = 0) AS n FROM v_insight GROUP BY ALL)
    SELECT topic_id, CASE WHEN a.n > b.n THEN 'a' ELSE 'b' END AS side, kind AS item, abs(a.n - b.n) AS times FROM a JOIN b USING (topic_id, kind) WHERE a.n <> b.n""")
def listing_differences(spark, sf):
    a = view(spark, sf, "v_insight").select("topic_id", F.col("kind").alias("item"), "o_orderkey")
    b = a.where("o_orderkey % 9 <> 0").unionByName(a.where("o_orderkey % 10 = 0"))
    return reconcile.listing_differences(a, b, "topic_id")


@query("""WITH l AS (SELECT kind, count(*) AS total, count(*) FILTER (o_orderkey % 3 > 0) AS kept, count(*) FILTER (status = 'rejected') AS bad, count(*) FILTER (status = 'rejected' AND o_orderkey % 3 > 0) AS lft FROM v_insight GROUP BY kind),
    u AS (SELECT kind, count(*) AS calls, count(*) FILTER (l_linenumber = 1) AS hits, sum(CAST(l_quantity AS BIGINT)) AS inp, sum(l_linenumber) AS outp, sum(l_extendedprice) AS cost FROM v_insight JOIN lineitem ON l_orderkey = o_orderkey WHERE kind <> 'decision' GROUP BY kind),
    r AS (SELECT kind, 'rejected_rate' AS metric, bad AS numerator, total AS denominator, round(bad::DOUBLE / nullif(total, 0), 6) AS value, 'undefined' AS miss FROM l UNION ALL SELECT kind, 'rejected_rate_after_filter', lft, kept, round(lft::DOUBLE / nullif(kept, 0), 6), 'undefined' FROM l
      UNION ALL SELECT kind, 'items', NULL, NULL, total, 'undefined' FROM l UNION ALL SELECT kind, 'scored_items', NULL, NULL, kept, 'undefined' FROM l
      UNION ALL SELECT l.kind, m.metric, NULL, NULL, round(CASE m.metric WHEN 'calls' THEN calls WHEN 'cache_hits' THEN hits WHEN 'input_tokens' THEN inp WHEN 'output_tokens' THEN outp ELSE cost END::DOUBLE, 6), 'unavailable_usage' FROM l CROSS JOIN (VALUES ('calls'), ('cache_hits'), ('input_tokens'), ('output_tokens'), ('cost')) m(metric) LEFT JOIN u ON u.kind = l.kind)
    SELECT kind, metric, numerator::DOUBLE AS numerator, denominator::DOUBLE AS denominator, value::DOUBLE AS value, CASE WHEN value IS NULL THEN miss ELSE 'ok' END AS status FROM r WHERE metric <> 'cost'""")
def snapshot_rows(spark, sf):
    listed = view(spark, sf, "v_insight")
    usage = listed.where("kind <> 'decision'").join(view(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "kind", "1L AS calls", "IF(l_linenumber = 1, 1L, 0L) AS cache_hits", "CAST(l_quantity AS BIGINT) AS input_tokens", "CAST(l_linenumber AS BIGINT) AS output_tokens", "l_extendedprice AS cost")
    return reconcile.snapshot_rows(listed, F.col("o_orderkey") % 3 > 0, False, usage, "kind").where("metric <> 'cost'")


_ALIAS = """ex AS (SELECT DISTINCT chat, topic FROM v_msg), al AS (SELECT g.chat, g.topic, CASE WHEN e.topic IS NULL THEN g.topic ELSE e.topic END AS root FROM ex g LEFT JOIN ex e ON e.chat = g.chat AND right(g.topic, 1) = '2' AND e.topic = left(g.topic, len(g.topic) - 1) || '1')"""


def _cascade(spark, sf):
    msg = _msg(spark, sf)
    known = msg.select("chat", "topic").distinct()
    to = known.selectExpr("chat", "topic", "IF(right(topic, 1) = '2', concat(left(topic, length(topic) - 1), '1'), topic) AS root")
    aliases = to.join(known.withColumnRenamed("topic", "root"), ["chat", "root"]).select("chat", "topic", "root")
    held = msg.groupBy("chat", "topic").agg(F.lit("active").alias("state"), F.max("ms").alias("last_ms"))
    every = lambda k: msg.where(F.col("ordinal") % k == 0).select("chat", F.col("message_id").alias("id"), "topic")
    return reconcile.merge_cascade(aliases, held, msg.select("chat", "message_id", "topic"), every(7), every(5), topics.merge_pairs(msg).select("chat", "a", "b"))


@query(f"""WITH {_ALIAS}, h AS (SELECT chat, topic, max(ms) AS last_ms FROM v_msg GROUP BY ALL), j AS (SELECT h.*, al.root FROM h JOIN al USING (chat, topic))
    SELECT chat, topic, CASE WHEN topic = root THEN 'active' ELSE 'merged' END AS state, CASE WHEN topic <> root THEN root END AS merged_into, CASE WHEN topic = root THEN max(last_ms) OVER (PARTITION BY chat, root) ELSE last_ms END AS last_ms FROM j""")
def merge_cascade_topics(spark, sf):
    return _cascade(spark, sf)["topics"]


@query(f"""WITH {_ALIAS}, {_PAIRS}, m AS (SELECT v.chat, v.ordinal, al.root FROM v_msg v JOIN al USING (chat, topic))
    SELECT 'members' AS what, chat, root AS topic, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'insights', chat, root, count(*) FROM m WHERE ordinal % 7 = 0 GROUP BY ALL UNION ALL SELECT 'relations', chat, root, count(*) FROM m WHERE ordinal % 5 = 0 GROUP BY ALL
    UNION ALL SELECT 'rejected', chat, a, count(*) FROM (SELECT DISTINCT p.chat, least(x.root, y.root) AS a, greatest(x.root, y.root) AS b FROM p JOIN al x ON x.chat = p.chat AND x.topic = p.a JOIN al y ON y.chat = p.chat AND y.topic = p.b WHERE x.root <> y.root) GROUP BY ALL""")
def merge_cascade_moved(spark, sf):
    """How many members, insights, relations and rejected pairs each topic has once all follow."""
    made, out = _cascade(spark, sf), None
    for what, column in (("members", "topic"), ("insights", "topic"), ("relations", "topic"), ("rejected", "a")):
        one = made[what].groupBy(F.lit(what).alias("what"), "chat", F.col(column).alias("topic")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_SEEN = r"""sn AS (SELECT message_id, recalled, ordinal, CASE WHEN recalled THEN '' ELSE CASE WHEN is_system THEN '[系统]' ELSE '' END || text || CASE WHEN ordinal % 5 = 0 THEN '[合并转发:T' || ordinal || ']' || chr(10) || '  > ' || sender || ': fwd ' || ordinal ELSE '' END END AS seen FROM v_msg),
    qs AS (SELECT 'i' || ordinal AS insight_id, CASE WHEN ordinal % 4 = 0 THEN 'fwd' || chr(9) || ordinal WHEN ordinal % 4 = 1 THEN 'no such' END AS due, CASE WHEN ordinal % 3 = 0 THEN 'topic_summary' ELSE 'todo' END AS kind, CASE WHEN ordinal % 20 = 3 THEN 2 ELSE 1 END AS profile, ordinal FROM v_msg WHERE ordinal % 2 = 0 OR ordinal % 3 = 0),
    qe AS (SELECT 'i' || ordinal AS insight_id, 1 AS idx, message_id, CASE ordinal % 6 WHEN 0 THEN 'fwd  ' || ordinal WHEN 2 THEN 'ab' ELSE text END AS quote FROM v_msg WHERE (ordinal % 2 = 0 OR ordinal % 3 = 0) AND ordinal % 25 <> 4 UNION ALL SELECT 'i' || ordinal, 2, 'm-1', 'none' FROM v_msg WHERE ordinal % 9 = 0),
    fl AS (SELECT qe.*, qs.due, qs.profile, seen, CASE WHEN seen IS NULL THEN 'message_not_found' WHEN recalled THEN 'recalled' WHEN len(regexp_replace(quote, '\s', '', 'g')) < 3 THEN 'quote_too_short'
      WHEN NOT contains(regexp_replace(seen, '\s', '', 'g'), regexp_replace(quote, '\s', '', 'g')) THEN 'quote_not_found' END AS failure FROM qe JOIN qs USING (insight_id) LEFT JOIN sn USING (message_id)),
    ag AS (SELECT insight_id, count(*) FILTER (failure IS NULL) AS ok, string_agg(failure, ',' ORDER BY idx) AS bad, coalesce(bool_or(failure IS NULL AND contains(regexp_replace(seen, '\s', '', 'g'), regexp_replace(due, '\s', '', 'g'))), false) AS sup FROM fl WHERE profile = 1 GROUP BY insight_id),
    fs AS (SELECT qs.insight_id, kind, due, coalesce(ok, 0) AS ok, CASE WHEN profile <> 1 THEN 'unsupported_profile' ELSE concat_ws(',', CASE WHEN ag.insight_id IS NULL THEN 'no_evidence' ELSE bad END, CASE WHEN due IS NOT NULL AND NOT coalesce(sup, false) THEN 'deadline_not_in_evidence' END) END AS failures FROM qs LEFT JOIN ag USING (insight_id))"""


def _seen(spark, sf):
    bundle = "IF(ordinal % 5 = 0, named_struct('title', concat('T', ordinal), 'messages', array(named_struct('sender', sender, 'text', concat('fwd ', ordinal), 'forward', CAST(NULL AS struct<title:string,messages:array<struct<sender:string,text:string,forward:struct<title:string>>>>)))), NULL) AS forward"
    return verify.rendered(_msg(spark, sf).selectExpr("message_id", "text", "is_system AS system", "recalled", bundle))


def _quoted(spark, sf):
    msg = _msg(spark, sf)
    some = msg.where("ordinal % 2 = 0 OR ordinal % 3 = 0")
    insights = some.selectExpr("concat('i', ordinal) AS insight_id", "CASE WHEN ordinal % 4 = 0 THEN concat('fwd', chr(9), ordinal) WHEN ordinal % 4 = 1 THEN 'no such' END AS deadline_raw", "IF(ordinal % 3 = 0, 'topic_summary', 'todo') AS kind", "IF(ordinal % 20 = 3, 2, 1) AS profile")
    first = some.where("ordinal % 25 <> 4").selectExpr("concat('i', ordinal) AS insight_id", "1 AS idx", "message_id", "CASE ordinal % 6 WHEN 0 THEN concat('fwd  ', ordinal) WHEN 2 THEN 'ab' ELSE text END AS quote")
    return insights, first.unionByName(msg.where("ordinal % 9 = 0").selectExpr("concat('i', ordinal) AS insight_id", "2 AS idx", "'m-1' AS message_id", "'none' AS quote"))


@query(f"WITH {_SEEN} SELECT message_id, seen AS text, recalled FROM sn")
def rendered_messages(spark, sf):
    """What a reader sees of each message of the message view."""
    return _seen(spark, sf)


@query(f"WITH {_SEEN} SELECT insight_id, CASE WHEN failures = '' THEN 'verified' WHEN kind = 'topic_summary' AND due IS NULL AND ok > 0 THEN 'unverified' ELSE 'rejected' END AS status, ok, failures FROM fs")
def verify_rendered(spark, sf):
    """Evidence against what a reader sees, deadlines against evidence that holds."""
    insights, evidence = _quoted(spark, sf)
    return verify.verify_rendered(insights, evidence, _seen(spark, sf))


@query(rf"""WITH {_SEEN} SELECT insight_id, idx, message_id, replace(regexp_replace(quote, '\s', '', 'g'), ' ', '') AS covered FROM fl WHERE failure IS NULL""")
def rendered_spans(spark, sf):
    """The characters of the render view that a quote covers, white space aside, are the quote's."""
    _, evidence = _quoted(spark, sf)
    seen = _seen(spark, sf)
    spans = verify.rendered_spans(evidence, seen).join(seen, "message_id")
    covered = F.substring(F.col("text"), (F.col("at") + 1).cast("int"), (F.col("until") - F.col("at")).cast("int"))
    return spans.select("insight_id", "idx", "message_id", F.regexp_replace(covered, r"(?U)\s", "").alias("covered"))


@query("""WITH k AS (SELECT user_id, count(*) AS n, user_id % 8 AS c FROM events GROUP BY user_id),
    r AS (SELECT user_id AS file, n AS events, CASE WHEN c = 1 AND n > 1 THEN 'not an object' WHEN c = 2 AND n > 1 THEN 'schema version' WHEN c = 3 AND n > 1 THEN 'gap in numbers' WHEN c = 4 AND n > 1 THEN 'another run'
      WHEN c = 5 AND n > 1 THEN 'malformed event' WHEN c = 6 THEN 'without done' WHEN c = 7 THEN 'exit code' END AS rule FROM k)
    SELECT file, events, CASE WHEN rule IN ('without done', 'exit code') THEN events - 1 WHEN rule IS NOT NULL THEN 1 END AS line, rule FROM r""")
def event_log_strict(spark, sf):
    """Logs of a run a user, each broken in its own way: version, numbers, run, payloads, end, exit code. Unknown events are fine."""
    rows = view(spark, sf, "events").selectExpr("user_id AS file", "event_type", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line", "count(*) OVER (PARTITION BY user_id) AS n")
    made = """CASE WHEN file % 8 = 1 AND line = 1 THEN '{' ELSE concat('{"schema_version":"', IF(file % 8 = 2 AND line = 1, '2.0', '1.3'), '","run_id":"', IF(file % 8 = 4 AND line = 1, 'x', 'r'), '","seq":', line + IF(file % 8 = 3 AND line > 0, 1, 0),
      ',"event":"', CASE WHEN file % 8 = 5 AND line = 1 THEN 'message' WHEN line = n - 1 AND file % 8 <> 6 THEN 'done' ELSE event_type END, '","payload":', IF(line = n - 1 AND NOT (file % 8 = 5 AND line = 1), '{"status":"complete","exit_code":6}', '{}'), '}') END"""
    lines = rows.selectExpr("file", "CAST(line AS BIGINT) AS line", f"{made} AS raw")
    exits = rows.select("file").distinct().where("file % 8 IN (0, 7)").selectExpr("file", "IF(file % 8 = 0, 6L, 0L) AS exit_code")
    return contracts.log_problems(lines, exits)


@query("""WITH s AS (SELECT chat, 'mentions' AS section, message_id, ms, ordinal FROM v_msg WHERE NOT recalled AND mention = 'all' UNION ALL SELECT chat, 'unread_topics', topic, max(ms), 0 FROM v_msg WHERE state = 'pending' GROUP BY chat, topic
      UNION ALL SELECT chat, 'hot_topics', topic, count(*), 0 FROM v_msg WHERE NOT recalled GROUP BY chat, topic), c AS (SELECT chat, section, count(*) AS n FROM s GROUP BY ALL)
    SELECT s.chat::VARCHAR AS chat, section, row_number() OVER (PARTITION BY s.chat, section ORDER BY CASE section WHEN 'hot_topics' THEN -ms ELSE ms END, ordinal, message_id) AS place, message_id AS item, ms AS n, c.n AS header FROM s JOIN c USING (chat, section)""")
def overview_export(spark, sf):
    """Sections of differently shaped rows, written a folder a section and read back, with the sizes that a header tells."""
    msg = _msg(spark, sf)
    mentions = msg.where("NOT recalled AND mention = 'all'").select("chat", F.col("message_id").alias("item"), F.col("ms").alias("n"), "ordinal", "text")
    unread = msg.where("state = 'pending'").groupBy("chat", F.col("topic").alias("item")).agg(F.max("ms").alias("n"), F.collect_set("sender").alias("senders"))
    hot = msg.where("NOT recalled").groupBy("chat", F.col("topic").alias("item")).agg(F.count("*").alias("n"))
    tagged = sinks.tagged_sections({"mentions": (mentions, ["n", "ordinal"]), "unread_topics": (unread, ["n", "item"]), "hot_topics": (hot, [F.desc("n"), "item"])})
    path = fresh_path(spark, "sections")
    sinks.write_sections(tagged, path)
    rows = sinks.read_sections(spark, path)
    return rows.select("chat", "section", "place", F.variant_get("row", "$.item", "string").alias("item"), F.variant_get("row", "$.n", "bigint").alias("n"), F.element_at("header", F.col("section")).alias("header"))


@query("""WITH a AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'unlabelled_subject' WHEN task IS NULL OR model IS NULL THEN 'no task' END AS excluded FROM v_prob), u AS (SELECT * FROM a WHERE excluded IS NULL),
    b AS (SELECT model, task, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, sum(y)::BIGINT AS positives, round(sum(p) / count(*), 6)::DOUBLE AS mean, abs(sum(p) - sum(y)) AS gap, sum((p - y) * (p - y)) AS sq FROM u GROUP BY ALL),
    g AS (SELECT model, task, sum(n)::BIGINT AS count, round(sum(gap) / sum(n), 6)::DOUBLE AS ece, round(sum(sq) / sum(n), 6)::DOUBLE AS brier FROM b GROUP BY ALL)
    SELECT model, task, count, ece, brier, bin, n, positives, mean, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM u) AS included FROM b JOIN g USING (model, task)""")
def calibration_export(spark, sf):
    """The nested report, written as JSON and read back."""
    rows = view(spark, sf, "v_prob").withColumn("excluded", F.when(F.col("doc_id") % 7 == 0, "unlabelled_subject").when(F.col("task").isNull() | F.col("model").isNull(), "no task"))
    path = fresh_path(spark, "report")
    sinks.write_report(sinks.calibration_report(rows), path)
    return sinks.read_report(spark, path)


@query("""SELECT insight_id, off AS offset_min, CASE WHEN bound_sec IS NOT NULL THEN epoch(bound_date)::BIGINT + bound_sec - off * 60 >= 946684800 ELSE bound_date >= DATE '2000-01-01' + ((off * 60 < 0)::INT * -1) END AS open
    FROM (SELECT *, (o_orderkey % 5 - 2) * 300 AS off FROM v_insight) WHERE bound_date IS NOT NULL""")
def deadline_open_offsets(spark, sf):
    """Deadlines by the clocks of their anchors, from ten hours west to ten hours east."""
    rows = view(spark, sf, "v_insight").where("bound_date IS NOT NULL").withColumn("offset_min", (F.col("o_orderkey") % 5 - 2) * 300)
    return rows.select("insight_id", "offset_min", rank.deadline_open_at(946_684_800, F.col("offset_min")).alias("open"))


@query("""WITH r AS (SELECT o_custkey AS run, min(epoch_us(o_orderdate) // 1000) AS started_ms, max(epoch_us(o_orderdate) // 1000) - 1000 AS ended_ms FROM orders GROUP BY 1),
    l AS (SELECT o_custkey AS run, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS tops, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS ver, count(*) FILTER (l_linenumber = 1) AS ins, sum(l_linenumber) AS calls FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT r.run, r.run % 3 = 0 AS exact, CASE WHEN r.run % 3 = 0 THEN 7 ELSE coalesce(lines, 0) END AS messages, CASE WHEN r.run % 3 = 0 THEN 1 ELSE coalesce(tops, 0) END AS topics_created, CASE WHEN r.run % 3 = 0 THEN 2 ELSE coalesce(ver, 0) END AS topics_updated,
      CASE WHEN r.run % 3 = 0 THEN 3 ELSE coalesce(ins, 0) END AS insights_created, CASE WHEN r.run % 3 = 0 THEN 99 ELSE greatest(ended_ms - started_ms, 0) END AS elapsed_ms, coalesce(calls, 0)::BIGINT AS calls FROM r LEFT JOIN l USING (run)""")
def run_stats_kept(spark, sf):
    """Every third run has saved counters; the others are told from surviving rows."""
    orders = view(spark, sf, "orders").withColumn("at", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    runs = orders.groupBy(F.col("o_custkey").alias("run")).agg(F.min("at").alias("started_ms"), (F.max("at") - 1000).alias("ended_ms"))
    saved = runs.where("run % 3 = 0").selectExpr("run", "7L AS messages", "1L AS topics_created", "2L AS topics_updated", "3L AS insights_created", "99L AS elapsed_ms")
    lines = orders.join(view(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_custkey", "run")
    checks = lines.selectExpr("run", "IF(l_linestatus = 'O', 'verify', 'extract') AS stage", "IF(l_returnflag = 'N', 'complete', 'failed') AS status")
    usage = lines.selectExpr("run", "CAST(l_linenumber AS BIGINT) AS calls", "l_extendedprice AS cost")
    return scores.run_stats_kept(runs, saved, lines.select("run"), lines.where("l_returnflag = 'R'").select("run"), lines.where("l_linenumber = 1").select("run"), checks, usage).drop("cost")


@query("""WITH m AS (SELECT chat::VARCHAR AS chat, message_id, topic FROM v_msg), e AS (SELECT m.chat FROM v_evidence v JOIN m USING (message_id)), r AS (SELECT chat, 'messages' AS name FROM m UNION ALL SELECT chat, 'evidence' FROM e
      UNION ALL SELECT m.chat, 'lines' FROM v_evidence v JOIN m USING (message_id) JOIN orders ON 'i' || o_orderkey = v.insight_id)
    SELECT chat, name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT NULL, 'messages', count(*) FROM v_msg UNION ALL SELECT NULL, 'evidence', count(*) FROM v_evidence UNION ALL SELECT NULL, 'lines', count(*) FROM v_evidence UNION ALL SELECT NULL, 'parts', count(*) FROM part""")
def scoped_counts(spark, sf):
    """Rows of tables in all and by chat: messages have one, evidence through its message, lines through their order too, parts none."""
    msg, evidence = _msg(spark, sf), view(spark, sf, "v_evidence")
    by_order = view(spark, sf, "orders").select(F.concat(F.lit("i"), "o_orderkey").alias("insight_id"))
    parent = msg.select("message_id", "chat")
    return scores.scoped_counts({"messages": (msg, []), "evidence": (evidence, [(parent, "message_id")]), "lines": (evidence, [(parent, "message_id"), (by_order, "insight_id")]), "parts": (view(spark, sf, "part"), None)})


_MADE = """ids AS (SELECT *, 'i_' || left(sha256(concat_ws('|', chat::VARCHAR, topic, 'run1', 'mention:' || message_id)), 16) AS mid, 'i_' || left(sha256(concat_ws('|', chat::VARCHAR, topic, 'run1', 'summary')), 16) AS sid FROM v_msg),
    long AS (SELECT message_id, seen, len(regexp_replace(left(seen, 60), '\\s', '', 'g')) AS said FROM sn)"""


@query(f"""WITH {_SEEN}, {_MADE} SELECT mid AS insight_id, chat, topic, 'mention_me' AS kind, '有人在群聊中提及你' AS title, left(seen, 200) AS summary, CASE WHEN ordinal % 101 >= 50 THEN 'P0' ELSE 'P1' END AS priority, 'me' AS assignee, 1.0::DOUBLE AS confidence,
    'open' AS lifecycle, 'run1' AS created_in_run, CASE WHEN recalled OR said < 3 THEN 'rejected' ELSE 'verified' END AS status, message_id || ':' || left(seen, 60) AS evidence
    FROM ids JOIN long USING (message_id) WHERE mention IS NOT NULL AND ordinal % 7 <> 0""")
def mention_insights_whole(spark, sf):
    """Mentions that no evidence covers (every seventh is covered), as whole insights."""
    msg = _msg(spark, sf)
    new = msg.select("chat", "topic", "message_id", F.col("mention").isNotNull().alias("mentions_me"), (F.col("ordinal") % 101 / 100).alias("p_action"))
    made = synthesis.mention_insights(new, _seen(spark, sf), msg.where("ordinal % 7 = 0"), "run1")
    return made.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["message_id"], e["quote"])), "|"))


@query(f"""WITH {_SEEN}, {_MADE}, o AS (SELECT chat, topic, min(ordinal) AS n, any_value(sid) AS sid FROM ids GROUP BY chat, topic), k AS (SELECT i.*, row_number() OVER (PARTITION BY chat, topic ORDER BY ms, message_id) AS k FROM ids i WHERE ordinal % 3 > 0),
    e AS (SELECT chat, topic, string_agg(message_id || ':' || left(seen, 60), '|' ORDER BY k) AS evidence, count(*) AS n_all, count(*) FILTER (NOT recalled AND said >= 3) AS fine FROM k JOIN long USING (message_id) WHERE k <= 2 GROUP BY chat, topic)
    SELECT CASE WHEN n % 5 = 0 THEN 'old' || n ELSE sid END AS insight_id, chat, topic, 'topic_summary' AS kind, 'about ' || topic AS title, 'all of ' || topic AS summary, CASE WHEN n % 10 >= 5 THEN 'P3' ELSE 'P2' END AS priority, 'unknown' AS assignee, NULL::DOUBLE AS confidence,
      'open' AS lifecycle, CASE WHEN n % 5 = 0 THEN 'run0' ELSE 'run1' END AS created_in_run, CASE WHEN coalesce(n_all, 0) > 0 AND fine = n_all THEN 'verified' WHEN fine > 0 THEN 'unverified' ELSE 'rejected' END AS status, coalesce(evidence, '') AS evidence
    FROM o LEFT JOIN e USING (chat, topic) WHERE n % 4 > 0""")
def summary_insights_whole(spark, sf):
    """Summaries of topics with their first new messages; a topic that has one keeps its id, a blank one makes none."""
    msg = _msg(spark, sf)
    each = msg.groupBy("chat", "topic").agg(F.min("ordinal").alias("n"))
    outputs = each.select("chat", "topic", F.concat(F.lit("about "), "topic").alias("title"), F.when(F.col("n") % 4 > 0, F.concat(F.lit("all of "), "topic")).otherwise(" ").alias("summary"), (F.col("n") % 10 / 10).alias("p_chitchat"))
    previous = each.where("n % 5 = 0").select("chat", "topic", F.concat(F.lit("old"), "n").alias("insight_id"), F.lit("run0").alias("created_in_run"))
    made = synthesis.summary_insights(outputs, msg.where("ordinal % 3 > 0").select("chat", "topic", "message_id", "ms"), _seen(spark, sf), previous, "run1")
    return made.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["message_id"], e["quote"])), "|"))


@query("SELECT DISTINCT s.insight_id, CAST(s.topic_id AS VARCHAR) AS topic, CAST(s.topic_id + 1 AS VARCHAR) AS other FROM v_insight s WHERE o_orderkey % 13 = 0")
def upsert_conflicts(spark, sf):
    """Proposals that would move a stored insight to another topic."""
    stored = view(spark, sf, "v_insight").select("insight_id", F.col("topic_id").cast("string").alias("topic"), F.when(F.col("o_orderkey") % 13 == 0, F.col("topic_id") + 1).otherwise(F.col("topic_id")).cast("string").alias("new"))
    return synthesis.topic_conflicts(stored.select("insight_id", "topic"), stored.select("insight_id", F.col("new").alias("topic")))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars % 101 / 100.0 END::DOUBLE AS a, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 50 / 100.0 END::DOUBLE AS b, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 9 = 0 THEN -1 ELSE (doc_id % 7 + 1) / 10.0 END::DOUBLE AS c FROM documents),
    s AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'options' WHEN c < 0 OR a + b + c = 0 THEN 'probability' ELSE 'ok' END AS status, (a + b + c)::DOUBLE AS t, greatest(a, b, c) AS m FROM d)
    SELECT doc_id AS key, CASE WHEN status = 'ok' AND doc_id % 2 = 0 THEN CASE WHEN a = m THEN '0' WHEN b = m THEN '1' ELSE '2' END END AS choice, CASE WHEN status = 'ok' AND doc_id % 2 = 1 THEN floor(((b / t) + 2 * (c / t)) * 100000 + 0.5) END AS score,
      CASE WHEN status = 'ok' THEN floor(greatest((3 * (m / t) - 1) / 2, 0) * 100000 + 0.5) END AS confidence, status FROM s""")
def read_answers(spark, sf):
    """Raw answers with weights that don't sum to one, some of them none, some on other options."""
    rows = view(spark, sf, "documents").selectExpr("doc_id AS key", "IF(doc_id % 2 = 0, 'choice', 'score') AS qtype", "IF(doc_id % 13 = 0, array('0', '1'), array('0', '1', '2')) AS options",
        "transform_values(map('0', n_chars % 101 / 100, '1', doc_id % 50 / 100, '2', IF(doc_id % 9 = 0, -1, (doc_id % 7 + 1) / 10)), (k, v) -> CAST(IF(doc_id % 11 = 0, 0, v) AS DOUBLE)) AS weights")
    parts = lambda c: F.floor(F.col(c) * 100_000 + 0.5).cast("double").alias(c)  # noqa: E731  hundred-thousandths
    return contracts.read_answers(rows).select("key", "choice", parts("score"), parts("confidence"), "status")


@query("""SELECT l_orderkey AS request_key, count(*) AS copies, CASE WHEN l_orderkey % 4 = 0 THEN 'duplicate' WHEN l_orderkey % 4 = 1 THEN 'replay' ELSE 'conflict' END AS status FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def replayed_answers(spark, sf):
    """Answers to a request a line: equal ones, the controller's about other states, others about other subjects, and other answers."""
    li = view(spark, sf, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    rows = li.selectExpr("'m' AS model", "l_orderkey AS request_key", "'q' AS question_id", "IF(l_orderkey % 4 IN (1, 3), 'controller', 'message') AS subject_kind", "IF(l_orderkey % 4 = 3, concat('a', k), 'yes') AS answer", "0.5D AS confidence", "'choice' AS qtype", "'T0,T1' AS candidates", "IF(l_orderkey % 4 IN (1, 2), concat('s', k), 's') AS subject")
    return contracts.replayed_answers(rows).select("request_key", "copies", "status")


@query("""WITH i AS (SELECT o_custkey AS req, o_orderkey AS item, o_orderkey % 12 AS k FROM orders), u AS (SELECT req, k, count(*) AS n FROM i WHERE k IN (3, 5) GROUP BY req, k)
    SELECT req, item, rule FROM i JOIN (VALUES (1, 'kind'), (1, 'updates another kind'), (2, 'title length'), (3, 'update of no open item'), (4, 'updates another kind'), (6, 'new item names another'), (7, 'empty deadline'), (8, 'unknown evidence'), (9, 'op')) r(k, rule) USING (k)
    UNION ALL SELECT req, item, 'item is updated twice' FROM i JOIN u USING (req, k) WHERE n > 1""")
def proposal_problems(spark, sf):
    """Proposals a customer against two open items and the messages that were shown."""
    rows = view(spark, sf, "orders").selectExpr("o_custkey AS req", "o_orderkey AS item", "o_orderkey % 12 AS k")
    items = rows.selectExpr("req", "item", "CASE WHEN k IN (1, 3, 4, 5) THEN 'update' WHEN k = 9 THEN 'drop' ELSE 'new' END AS op", "CASE k WHEN 1 THEN concat('b', item) WHEN 3 THEN 'gone' WHEN 4 THEN concat('a', item) WHEN 5 THEN 'same' WHEN 6 THEN concat('a', item) END AS existing_ref",
        "IF(k = 1, 'praise', 'todo') AS kind", "'me' AS assignee", "IF(k = 2, repeat('x', 41), 'do it') AS title", "'' AS summary", "IF(k = 7, ' ', NULL) AS deadline_raw")
    each = rows.select("req", F.explode(F.array(F.concat(F.lit("a"), "item"), F.concat(F.lit("b"), "item"))).alias("ref"))
    existing = each.withColumn("kind", F.when(F.col("ref").startswith("a"), "decision").otherwise("todo")).union(rows.select("req", F.lit("same"), F.lit("todo")).distinct())
    evidence = rows.selectExpr("req", "item", "IF(k = 8, 'n99', 'n1') AS ref").union(rows.selectExpr("req", "item", "'n2'"))
    known = rows.select("req").distinct().select("req", F.explode(F.array(F.lit("n1"), F.lit("n2"))).alias("ref"))
    return contracts.proposal_problems(items, existing, evidence, known, "req")


@query(f"""WITH {_SEEN}, s AS (SELECT chat, message_id, sum(len(seen) + 256) OVER (PARTITION BY chat ORDER BY ms DESC, v.ordinal DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM v_msg v JOIN sn USING (message_id)) SELECT * FROM s WHERE used <= 96000""")
def suffix_rendered(spark, sf):
    """The newest messages that fit into a report, by what a reader sees of them: forwards count, recalled messages show nothing."""
    return overview.suffix_within(_msg(spark, sf).drop("text", "recalled").join(_seen(spark, sf), "message_id"), 96_000)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY chat, topic ORDER BY ms DESC, ordinal DESC) AS k FROM v_msg WHERE NOT recalled AND state <> 'pending'),
    c AS (SELECT chat, topic, message_id, 'c' || row_number() OVER (PARTITION BY chat, topic ORDER BY ms, ordinal) AS ref FROM n WHERE k <= 5),
    w AS (SELECT DISTINCT m.chat, m.topic, m.message_id, m.ms, m.ordinal FROM v_evidence e JOIN v_msg m USING (message_id) WHERE NOT m.recalled AND m.message_id NOT IN (SELECT message_id FROM c))
    SELECT * FROM c UNION ALL SELECT chat, topic, message_id, 's' || row_number() OVER (PARTITION BY chat, topic ORDER BY ms, ordinal) FROM w""")
def context_with_sources(spark, sf):
    msg = _msg(spark, sf)
    sources = view(spark, sf, "v_evidence").select("message_id").distinct().join(msg.select("message_id", "chat", "topic"), "message_id")
    return topics.context_with_sources(msg, sources)
