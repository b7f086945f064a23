"""Gold items and annotation sheets: strict reading, and the rules that a row breaks.

Items are read as VARIANT, so that a field that is null differs from one that is missing, and a number from its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import ASSIGNEES, KINDS, broken_rules

#: Fields, columns and grades of the formats.
ITEM_FIELDS = ("item_id", "kind", "assignee", "anchors", "deadline", "importance")
DEADLINE_FIELDS = ("raw", "relation", "bound_date")
SHEET = ("sheet_version", "message_id", "sent_at", "sender", "sender_display", "display_text", "thread", "todo", "announcement", "items_json")
SOURCE = ("sent_at", "sender", "sender_display", "display_text")
GRADES = ("P0", "P1", "P2", "P3")
MESSAGE_ID = "^m_[0-9a-fA-F]{16}$"


def _kind(v: Column, path: str) -> Column:
    """Type of what is at a path: STRING, VOID (null), ...; null if there is nothing."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    return F.when(_kind(v, path) == "STRING", F.variant_get(v, path, "string"))


def _only(keys: Column, known: tuple) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0


def _id(c: Column) -> Column:
    return (F.trim(c) != "") & ~c.rlike(r"(?U)^\s|\s$|\p{Cc}")


def item_rules(v: Column, id_pattern: str = MESSAGE_ID) -> dict[str, Column]:
    """Rules of an item in a VARIANT column. An explicit null deadline is none; a missing one breaks a rule."""
    keys, due = F.json_object_keys(F.to_json(v)), F.variant_get(v, "$.deadline", "variant")
    held = F.when(F.schema_of_variant(v).startswith("OBJECT"), keys)
    anchors = F.when(_kind(v, "$.anchors") == "ARRAY<STRING>", F.from_json(F.to_json(F.variant_get(v, "$.anchors", "variant")), "array<string>"))
    no_due = due.isNull() | F.is_variant_null(due)
    named = lambda f: F.coalesce(~_kind(v, f"$.deadline.{f}").isin("VOID"), F.lit(False))
    date = _text(v, "$.deadline.bound_date")
    return {
        "not an object": held.isNotNull(),
        "unknown field": held.isNull() | _only(held, ITEM_FIELDS),
        "field is missing": held.isNull() | (F.size(F.array_except(F.array(*map(F.lit, ITEM_FIELDS)), held)) == 0),
        "item id": _id(_text(v, "$.item_id")),
        "kind": _text(v, "$.kind").isin(*KINDS),
        "assignee": _text(v, "$.assignee").isin(*ASSIGNEES),
        "importance": _text(v, "$.importance").isin(*GRADES),
        "anchors": (F.size(anchors) > 0) & F.forall(anchors, lambda a: a.rlike(id_pattern)) & (F.size(F.array_distinct(anchors)) == F.size(anchors)),
        "deadline": no_due | F.schema_of_variant(due).startswith("OBJECT"),
        "unknown field of deadline": no_due | ~F.schema_of_variant(due).startswith("OBJECT") | _only(F.json_object_keys(F.to_json(due)), DEADLINE_FIELDS),
        "deadline text": no_due | (F.trim(_text(v, "$.deadline.raw")) != ""),
        "deadline date": no_due | (~named("relation") & ~named("bound_date"))
        | (named("relation") & named("bound_date") & _text(v, "$.deadline.relation").isin("before", "at", "after") & date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull()),
    }


def item_problems(lines: DataFrame, id_pattern: str = MESSAGE_ID) -> DataFrame:
    """line, rule for each rule that an item (line, raw JSON text) breaks; repeated item ids are told at all their lines.

    What isn't JSON, or has a key twice, is no object, and breaks no other rule than that.
    """
    rows = lines.select("line", F.try_parse_json("raw").alias("v"))
    broken = broken_rules(rows, item_rules(F.col("v"), id_pattern), "line")
    none = broken.where("rule = 'not an object'").select("line")
    broken = broken.where("rule = 'not an object'").union(broken.join(none, "line", "left_anti"))
    ids = rows.select("line", _text(F.col("v"), "$.item_id").alias("id")).where("id IS NOT NULL")
    twice = ids.join(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id").select("line", F.lit("item id is repeated").alias("rule"))
    return broken.union(twice)


def choice_problems(rows: DataFrame) -> DataFrame:
    """key, rows, problem: keys of gold choices (key) that are empty, or come more than once."""
    each = rows.groupBy("key").agg(F.count("*").alias("rows"))
    empty = F.coalesce(F.col("key"), F.lit("")) == ""
    return each.where(empty | (F.col("rows") > 1)).withColumn("problem", F.when(empty, "empty key").otherwise("repeated key"))


def label_status(lines: DataFrame, known: tuple = ("message_id", "thread", "todo", "announcement")) -> DataFrame:
    """line, status of gold labels (line, raw): ok, not an object, unknown field, or no message id."""
    keys = F.json_object_keys("raw")
    status = F.when(keys.isNull(), "not an object").when(~_only(keys, known), "unknown field").when(F.get_json_object("raw", "$.message_id").isNull(), "no message id").otherwise("ok")
    return lines.select("line", status.alias("status"))


def sheet(msg: DataFrame) -> DataFrame:
    """The ten columns of a sheet, as text: live messages, source cells with a prefix that keeps them text, label cells blank.

    msg: message_id, sent_at, sender, sender_display, display_text, recalled.
    """
    cells = [F.concat(F.lit("text:"), F.col(c).cast("string")).alias(c) for c in SOURCE]
    return msg.where("NOT recalled").select(F.lit("1").alias("sheet_version"), "message_id", *cells, *[F.lit("").alias(c) for c in SHEET[6:]])


def sheet_problems(rows: DataFrame, source: DataFrame, id_pattern: str = MESSAGE_ID) -> DataFrame:
    """message_id, rule for each rule that a filled-in sheet breaks; source: the sheet as it was given out.

    Rows: version, id, the four source cells as they were, a thread, explicit true or false, items as an array of whole items
    of which this message is an anchor. All rows: each message once, none missing, no item twice, anchors within the sheet.
    """
    rows = rows.select(*SHEET)
    was = source.select("message_id", *[F.col(c).alias(f"was_{c}") for c in SOURCE])
    v = F.try_parse_json("items_json")
    both = rows.join(was, "message_id", "left").withColumn("items", F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")))
    yes_no = lambda c: F.trim(c).isin("true", "false")
    rules = {
        "sheet version": F.col("sheet_version") == "1", "message id": F.col("message_id").rlike(id_pattern), "thread is missing": F.trim("thread") != "",
        "todo is not true or false": yes_no("todo"), "announcement is not true or false": yes_no("announcement"), "items are no array": F.col("items").isNotNull(),
        "message is not in the source": F.col("was_sender").isNotNull(),
        **{f"{c} was changed": F.col("was_sender").isNull() | (F.col(c) == F.col(f"was_{c}")) for c in SOURCE},
    }
    of_rows = broken_rules(both, rules, "message_id")
    items = both.select("message_id", F.explode("items").alias("item"))
    of_items = broken_rules(items, {f"item: {name}": ok for name, ok in item_rules(F.col("item"), id_pattern).items()}, "message_id").distinct()
    named = items.select("message_id", _text(F.col("item"), "$.item_id").alias("id"), F.from_json(F.to_json(F.variant_get("item", "$.anchors", "variant")), "array<string>").alias("anchors"))
    # An id may stand in any number of rows, so they are counted, not collected.
    repeated = named.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    twice = named.select("message_id", "id").join(repeated, "id", "left_semi").select("message_id", F.lit("item id is repeated").alias("rule")).distinct()
    own = named.where(~F.coalesce(F.array_contains("anchors", F.col("message_id")), F.lit(False))).select("message_id", F.lit("row is no anchor of its item").alias("rule")).distinct()
    ids = rows.select(F.col("message_id").alias("anchor")).distinct()
    lost = named.select("message_id", F.explode("anchors").alias("anchor")).join(ids, "anchor", "left_anti").select("message_id", F.lit("anchor is not in the sheet").alias("rule")).distinct()
    again = rows.groupBy("message_id").agg(F.count("*").alias("n")).where("n > 1").select("message_id", F.lit("message is repeated").alias("rule"))
    missing = source.join(rows, "message_id", "left_anti").select("message_id", F.lit("row is missing").alias("rule"))
    out = of_rows
    for more in (of_items, twice, own, lost, again, missing):
        out = out.unionByName(more)
    return out
