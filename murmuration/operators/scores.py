"""Samples, coverage and tables of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a task that joins items by message: the number of tasks grows with the tables, so the memory of one does not.
TASK_ROWS = 250_000


def match_candidates(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """pred, gold, overlap: items of one kind that share messages, by how many; pred, gold: (item, kind, message_id)."""
    tasks = max(1, -(-(pred.count() + gold.count()) // TASK_ROWS))

    def side(rows: DataFrame, name: str) -> DataFrame:
        # Dealt by message first: distinct() and the join both run on that one shuffle.
        return rows.select(F.col("item").alias(name), "kind", "message_id").repartition(tasks, "kind", "message_id").distinct()

    return side(pred, "pred").join(side(gold, "gold"), ["kind", "message_id"]).groupBy("pred", "gold").agg(F.count("*").alias("overlap"))


def calibration_samples(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answer_id, task, p, y, excluded: each answer with its label, or the reason why it has none; never a negative instead.

    answers: answer_id, qtype, subject_kind, subject_id, question, p. labels: subject_id, todo, announcement.
    """
    both = answers.join(labels.withColumn("labelled", F.lit(True)), "subject_id", "left")
    task = F.when(F.col("question").endswith("_todo"), "todo").when(F.col("question").endswith("_announcement"), "announcement")
    excluded = (
        F.when(F.col("qtype") != "noul", "unlabelled_question_type").when(F.col("subject_kind") != "message", "unlabelled_subject")
        .when(F.col("labelled").isNull(), "missing_message_gold").when(task.isNull(), "unlabelled_question")
    )
    y = F.when(task == "todo", F.col("todo")).otherwise(F.col("announcement"))
    return both.select("answer_id", F.when(excluded.isNull(), task).alias("task"), F.when(excluded.isNull(), F.col("p")).alias("p"), F.when(excluded.isNull(), y).alias("y"), excluded.alias("excluded"))


def ratio(num: Column, den: Column) -> Column:
    return F.round(F.try_divide(num.cast("double"), den), 6)


def thread_coverage(rows: DataFrame, *by: str) -> DataFrame:
    """by, assigned, messages, coverage, status: other thread measures are undefined without messages, unavailable without all assignments."""
    each = rows.groupBy(*by).agg(F.count("topic").alias("assigned"), F.count("*").alias("messages"))
    status = F.when(F.col("assigned") == F.col("messages"), "available").otherwise("unavailable_missing_assignments")
    return each.withColumns({"coverage": ratio(F.col("assigned"), F.col("messages")), "status": status})


def score_rows(measures: DataFrame, names: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """A row per measure: by, metric, value, numerator, denominator, status; names: metric -> columns of numerator and denominator."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(n).cast("bigint").alias("numerator"), F.col(d).cast("bigint").alias("denominator")) for m, (n, d) in names.items()])
    each = measures.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
    return each.withColumns({"value": ratio(F.col("numerator"), F.col("denominator")), "status": F.when(F.col("denominator") > 0, "ok").otherwise("undefined")})


def signal_fold(signals: DataFrame, *by: str) -> DataFrame:
    """by, urgency (greatest), chitchat (least), confidence (greatest), from the batches of a topic."""
    return signals.groupBy(*by).agg(F.max("urgency").alias("urgency"), F.min("chitchat").alias("chitchat"), F.max("confidence").alias("confidence"))


def run_stats(items: DataFrame, *by: str) -> DataFrame:
    """by, items, done, elapsed_ms of runs; items: by, done, at_ms."""
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.count_if("done").alias("done"), (F.max("at_ms") - F.min("at_ms")).alias("elapsed_ms"))


def receipt(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """what, key, n: how many rows of each part have each value of its column; parts: what -> (rows, column)."""
    out = None
    for what, (rows, column) in parts.items():
        one = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


def binned(samples: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """by, n, bins ("bin:samples:positives", joined by blanks) of samples (by, p, y)."""
    rows = samples.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    each = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("yes"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n", "yes"))), lambda b: F.concat_ws(":", b["bin"], b["n"], b["yes"]))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.array_join(text, " ").alias("bins"))


def label_signals(answers: DataFrame, labels: dict[str, float]) -> DataFrame:
    """subject, a column a label (whether some answer for it reaches its threshold), confidence; answers: subject, label, p, sure."""
    hit = [F.bool_or((F.col("label") == name) & (F.col("p") >= least)).alias(name) for name, least in labels.items()]
    return answers.groupBy("subject").agg(*hit, F.max("sure").alias("confidence"))


def run_stats_kept(runs: DataFrame, saved: DataFrame, messages: DataFrame, topics: DataFrame, insights: DataFrame, checkpoints: DataFrame, usage: DataFrame) -> DataFrame:
    """run, exact, messages, topics_created, topics_updated, insights_created, elapsed_ms, calls, cost of runs.

    A run whose counters were saved (run, messages, topics_created, topics_updated, insights_created, elapsed_ms) has these; any
    other has what the surviving rows tell: messages by the run that analysed them, topics and insights by the run that created
    them, completed verify checkpoints as updated topics, and the time from start to end or last sign of life, never below 0.
    Usage always comes from its rows. runs: run, started_ms, ended_ms; messages, topics, insights: run; checkpoints: run, stage,
    status; usage: run, calls, cost.
    """
    count = lambda rows, name: rows.groupBy("run").agg(F.count("*").alias(name))
    out = runs.select("run", F.greatest(F.col("ended_ms") - F.col("started_ms"), F.lit(0)).alias("_elapsed"))
    parts = {"messages": messages, "topics_created": topics, "topics_updated": checkpoints.where("stage = 'verify' AND status = 'complete'"), "insights_created": insights}
    for name, rows in parts.items():
        out = out.join(count(rows, f"_{name}"), "run", "left")
    out = out.join(saved.withColumn("_saved", F.lit(True)), "run", "left")
    out = out.join(usage.groupBy("run").agg(F.sum("calls").alias("calls"), F.sum("cost").alias("cost")), "run", "left")
    exact = F.coalesce("_saved", F.lit(False))
    told = [F.when(exact, F.col(n)).otherwise(F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in parts]
    return out.select("run", exact.alias("exact"), *told, F.when(exact, F.col("elapsed_ms")).otherwise(F.col("_elapsed")).alias("elapsed_ms"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def scoped_counts(tables: dict[str, tuple[DataFrame, list[tuple[DataFrame, str]] | None]], chat: str = "chat") -> DataFrame:
    """chat (null: all), name, n: rows of each table, and by chat where its rows belong to one.

    tables: name -> (rows, parents); rows that have no chat of their own reach it through parents, joined one after the other by
    their key; parents None: the table belongs to no chat. Parents are unique by key, so a row counts once.
    """
    out = None
    for name, (rows, parents) in tables.items():
        whole = rows.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("chat"), F.lit(name).alias("name"), "n")
        out = whole if out is None else out.unionByName(whole)
        if parents is None:
            continue
        for parent, key in parents:
            rows = rows.join(parent.select(key, *[c for c in parent.columns if c != key and c not in rows.columns]), key)
        out = out.unionByName(rows.groupBy(F.col(chat).cast("string").alias("chat")).agg(F.count("*").alias("n")).select("chat", F.lit(name).alias("name"), "n"))
    return out
