"""Checks of what models and annotators propose: each gives the rows that break a rule, or a status per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_found, squeezed


def broken_rules(rows: DataFrame, rules: dict[str, Column], *keep: str) -> DataFrame:
    """keep and rule, a row for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keep, F.explode(broken).alias("rule"))


#: Kinds and assignees of proposed items.
KINDS = ("todo", "announcement", "decision")
ASSIGNEES = ("me", "all", "other", "unknown")


def proposal_rules() -> dict[str, Column]:
    """Rules of a proposed item: kind, assignee, title, summary, update_of (the open item it updates, or null), update_kind."""
    return {
        "kind": F.col("kind").isin(*KINDS),
        "assignee": F.col("assignee").isin(*ASSIGNEES),
        "title length": F.length(F.trim("title")).between(1, 40),
        "summary length": F.length("summary") <= 200,
        "updates another kind": F.col("update_of").isNull() | (F.col("update_kind") == F.col("kind")),
    }


def partition_breaks(asked: DataFrame, got: DataFrame, *by: str) -> DataFrame:
    """by, ref, times: references of a request that an answer does not name exactly once, and those that it makes up (asked false)."""
    named = got.groupBy(*by, "ref").agg(F.count("*").alias("times"))
    both = asked.select(*by, "ref").distinct().withColumn("asked", F.lit(True)).join(named, [*by, "ref"], "full_outer")
    both = both.select(*by, "ref", F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("times", F.lit(0)).alias("times"))
    return both.where("NOT asked OR times <> 1")


def answer_status(options: Column, probabilities: Column, choice: Column) -> Column:
    """ok, or what is wrong with a distribution over options: array<string>, map<string, double>, string.

    It names just the options, each probability is one, they sum to 1 (within 0.001), and the choice is a greatest one.
    """
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return (
        F.when(F.array_sort(F.map_keys(probabilities)) != F.array_sort(options), "options")
        .when(~F.forall(values, lambda v: (v >= 0) & (v <= 1) & ~F.isnan(v)), "probability")
        .when(F.abs(total - 1.0) > 0.001, "sum")
        .when(F.element_at(probabilities, choice).isNull(), "choice")
        .when(F.element_at(probabilities, choice) < F.array_max(values), "no maximum")
        .otherwise("ok")
    )


def confidence(probabilities: Column) -> Column:
    """(n max - 1) / (n - 1), held to 0 to 1; 1 for a single option."""
    n, best = F.size(probabilities), F.array_max(F.map_values(probabilities))
    return F.when(n == 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n * best - 1) / F.greatest(n - 1, F.lit(1)))))


def repeated_answers(answers: DataFrame, key: list[str], payload: str) -> DataFrame:
    """key, copies, status of answers that come more than once: duplicate if all are equal, else conflict."""
    each = answers.groupBy(*key).agg(F.count("*").alias("copies"), F.countDistinct(F.coalesce(payload, F.lit("")), F.col(payload).isNull()).alias("kinds"))
    return each.where("copies > 1").select(*key, "copies", F.when(F.col("kinds") == 1, "duplicate").otherwise("conflict").alias("status"))


def normalized(probabilities: Column) -> Column:
    """A map of options to weights as a distribution; null if one is no probability or all are 0."""
    values = F.map_values(probabilities)
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(fine & (total > 0), F.transform_values(probabilities, lambda k, v: v / total))


def read_answers(answers: DataFrame) -> DataFrame:
    """answers (key, qtype, options, weights) with probabilities, choice, score, confidence and status as a model's raw answer is read.

    Weights are normalised first. A choice is the most probable option, of equal ones the smallest; a score (options are levels
    from 0) is the mean level. status: ok, options (keys differ from the options), or probability (no distribution).
    """
    p = normalized(F.col("weights"))
    rows = answers.withColumn("probabilities", p)
    entries = F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("key")))
    mean = F.aggregate(F.map_entries("probabilities"), F.lit(0.0), lambda a, e: a + e["key"].try_cast("double") * e["value"])
    status = F.when(F.array_sort(F.map_keys("weights")) != F.array_sort("options"), "options").when(F.col("probabilities").isNull(), "probability").otherwise("ok")
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    return rows.select(
        *answers.columns, F.when(ok, F.col("probabilities")).alias("probabilities"), F.when(ok & (F.col("qtype") == "choice"), F.array_min(entries)["key"]).alias("choice"),
        F.when(ok & (F.col("qtype") == "score"), mean).alias("score"), F.when(ok, confidence(F.col("probabilities"))).alias("confidence"), "status")


def replayed_answers(answers: DataFrame, key: tuple = ("model", "request_key", "question_id")) -> DataFrame:
    """key, copies, status of answers that come more than once: duplicate, replay or conflict.

    answers: key, subject_kind, answer, confidence, qtype, candidates, subject. Equal in everything: a duplicate. Questions of the
    controller may be asked again about another state: copies that differ in their subject only are replays. Else a conflict.
    """
    same = F.struct("answer", "confidence", "qtype", "candidates")
    each = answers.groupBy(*key).agg(
        F.count("*").alias("copies"), F.size(F.collect_set(F.to_json(F.struct(same.alias("a"), "subject_kind", "subject")))).alias("whole"), F.size(F.collect_set(F.to_json(same))).alias("part"), F.bool_and(F.col("subject_kind") == "controller").alias("controller"))
    status = F.when(F.col("whole") == 1, "duplicate").when(F.col("controller") & (F.col("part") == 1), "replay").otherwise("conflict")
    return each.where("copies > 1").select(*key, "copies", status.alias("status"))


def proposal_problems(items: DataFrame, existing: DataFrame, evidence: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """by, item, rule for each rule that proposed items break against what the request showed.

    items: by, item, op (new or update), existing_ref, kind, deadline_raw, and the columns of proposal_rules() but for update_of
    and update_kind, which come from existing (by, ref, kind). evidence: by, item, ref; known: by, ref. An update names one open
    item of its kind, which no other update of the same request names; a new item names none; evidence names shown messages.
    """
    old = existing.select(*by, F.col("ref").alias("existing_ref"), F.col("kind").alias("update_kind"))
    rows = items.join(old, [*by, "existing_ref"], "left").withColumn("update_of", F.col("existing_ref"))
    times = items.where("op = 'update' AND existing_ref IS NOT NULL").groupBy(*by, "existing_ref").agg(F.count("*").alias("_times"))
    rows = rows.join(times, [*by, "existing_ref"], "left")
    shown = evidence.join(known.select(*by, "ref").withColumn("_shown", F.lit(True)), [*by, "ref"], "left").groupBy(*by, "item").agg(F.bool_and(F.coalesce("_shown", F.lit(False))).alias("_all_shown"))
    rows = rows.join(shown, [*by, "item"], "left")
    update = F.col("op") == "update"
    rules = {
        **{k: v for k, v in proposal_rules().items() if k != "updates another kind"},
        "op": F.col("op").isin("new", "update"),
        "update of no open item": ~update | F.col("update_kind").isNotNull(),
        "updates another kind": ~update | F.col("update_kind").isNull() | (F.col("update_kind") == F.col("kind")),
        "item is updated twice": ~update | (F.coalesce("_times", F.lit(1)) == 1),
        "new item names another": (F.col("op") != "new") | F.col("existing_ref").isNull(),
        "empty deadline": F.col("deadline_raw").isNull() | (F.trim("deadline_raw") != ""),
        "unknown evidence": F.coalesce("_all_shown", F.lit(True)),
    }
    return broken_rules(rows, rules, *by, "item")


def relation_shape(kind: Column, target: Column, completeness: Column) -> Column:
    """Whether a relation has the ends and the completeness that its kind asks for."""
    return (
        F.when(kind == "question", target.isNull() & completeness.isNull())
        .when(kind == "answers", target.isNotNull() & F.coalesce(completeness.isin("full", "partial"), F.lit(False)))
        .when(kind.isin("replaces", "cancels", "conflicts"), target.isNotNull() & completeness.isNull())
        .otherwise(False)
    )


def relation_valid(rel: DataFrame, msg: DataFrame) -> DataFrame:
    """rel_id, valid: the shape is right, both quotes (three characters at least) stand in live messages of the chat, the source comes first.

    rel: rel_id, chat, kind, source_id, quote, target_id, target_quote, completeness.
    """
    def side(name: str) -> DataFrame:
        at = F.struct("ms", "ordinal").alias(f"{name}_at")
        return msg.where("NOT recalled").select("chat", F.col("message_id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"), at)

    rows = rel.join(side("source"), ["chat", "source_id"], "left").join(side("target"), ["chat", "target_id"], "left")
    good = lambda text, quote: F.coalesce((F.length(squeezed(F.col(quote))) >= 3) & quote_found(F.col(text), F.col(quote)), F.lit(False))
    ends = good("source_text", "quote") & ((F.col("kind") == "question") | (good("target_text", "target_quote") & F.coalesce(F.col("source_at") < F.col("target_at"), F.lit(False))))
    return rows.select("rel_id", (ends & relation_shape(F.col("kind"), F.col("target_id"), F.col("completeness"))).alias("valid"))


def relation_proposals(rows: DataFrame) -> DataFrame:
    """Proposed relations by content, and the question that each answer answers; equal ones once.

    rows: chat, topic, kind, source_id, quote, target_id, completeness. Adds rel_id, a digest of these.
    """
    columns = ["chat", "topic", "kind", "source_id", "quote", "target_id", "completeness"]
    asked = rows.where("kind = 'answers'").select("chat", "topic", F.lit("question").alias("kind"), "source_id", "quote", F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("completeness"))
    every = rows.select(columns).union(asked).distinct()
    return every.withColumn("rel_id", F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


def owned(members: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (topic, message_id) with status: ok, unknown message, or in another topic."""
    both = claims.join(members.select("message_id", F.col("topic").alias("own")), "message_id", "left")
    return both.select("topic", "message_id", F.when(F.col("own").isNull(), "unknown message").when(F.col("own") != F.col("topic"), "in another topic").otherwise("ok").alias("status"))


#: Version of the event format, and what the payload of each known event must have.
LOG_VERSION = r"^1\.\d+$"
PAYLOADS = {"message": ("message_id", "sent_at"), "inbox": ("chat_id", "counts"), "topic": ("topic_id", "title"), "insight": ("insight_id", "kind"), "done": ("status", "exit_code")}


def log_problems(lines: DataFrame, exits: DataFrame | None = None, payloads: dict[str, tuple] = PAYLOADS) -> DataFrame:
    """file, events, line, rule: the first rule that each event log breaks and where; both null for a valid log.

    lines: file, line (from 0), raw. A line is a JSON object of a known major version; numbers run with the lines; one run; a
    known event has its payload's fields; an unknown one is fine; done comes once, last. exits (file, exit_code): the exit code
    of the process, where it is known, is the one that done tells.
    """
    v = F.try_parse_json("raw")
    text = lambda path: F.try_variant_get("v", path, "string")
    rows = lines.select("file", "line", v.alias("v"), F.json_object_keys("raw").alias("keys"))
    rows = rows.select("file", "line", (F.col("v").isNotNull() & F.col("keys").isNotNull()).alias("fits"), text("$.schema_version").alias("version"), F.try_variant_get("v", "$.seq", "bigint").alias("seq"),
        text("$.run_id").alias("run"), text("$.event").alias("event"), F.json_object_keys(F.to_json(F.try_variant_get("v", "$.payload", "variant"))).alias("has"), F.try_variant_get("v", "$.payload.exit_code", "bigint").alias("exit_code"))
    known = F.lit(True)
    for event, fields in payloads.items():
        whole = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fields)), "has")) == 0, F.lit(False))
        known = F.when(F.col("event") == event, whole).otherwise(known)
    done = F.col("event") == "done"
    whole = rows.groupBy("file").agg(F.count("*").alias("events"), F.max("line").alias("last"), F.min_by("run", "line").alias("first_run"), F.min(F.when(done, F.col("line"))).alias("end"), F.max_by("exit_code", F.when(done, F.col("line"))).alias("told"))
    both = rows.join(whole, "file")
    rule = (
        F.when(~F.col("fits"), "not an object").when(F.col("line") > F.col("end"), "event after done").when(~F.coalesce(F.col("version").rlike(LOG_VERSION), F.lit(False)), "schema version")
        .when(F.coalesce(F.col("seq") != F.col("line"), F.lit(True)), "gap in numbers").when(F.col("run").isNull() | (F.col("run") != F.col("first_run")), "another run").when(F.col("event").isNull() | ~known, "malformed event")
    )
    first = both.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("file").agg(F.min(F.struct("line", "rule")).alias("x"))
    out = whole.join(first, "file", "left")
    ended = F.when(F.col("end").isNull(), "without done")
    if exits is not None:
        out = out.join(exits.select("file", F.col("exit_code").alias("process")), "file", "left")
        ended = ended.when(F.col("process").isNotNull() & ~F.col("process").eqNullSafe(F.col("told")), "exit code")
    line = F.when(F.col("x").isNotNull(), F.col("x.line")).when(ended.isNotNull(), F.col("last"))
    return out.select("file", "events", line.alias("line"), F.coalesce("x.rule", ended).alias("rule"))


def log_status(events: DataFrame) -> DataFrame:
    """file, events, status of event logs (file, line, seq, run_id, event, exit): ok, or the first rule that a log breaks.

    Numbers run from 0 without a gap, in order of lines; one run; done comes once, last.
    """
    each = events.groupBy("file").agg(
        F.count("*").alias("events"), F.count_if(F.coalesce(F.col("seq") != F.col("line"), F.lit(True))).alias("jumps"), F.countDistinct("run_id").alias("runs"),
        F.count_if(F.col("event") == "done").alias("done"), F.max_by("event", "line").alias("last"),
    )
    status = F.when(F.col("jumps") > 0, "gap in numbers").when(F.col("runs") > 1, "another run").when(F.col("done") == 0, "no end").when((F.col("done") > 1) | (F.col("last") != "done"), "event after the end").otherwise("ok")
    return each.select("file", "events", status.alias("status"))
