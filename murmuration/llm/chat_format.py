"""Chat formatting: layouts told by schema fingerprints, turned into canonical turns, and one reversible template.

Everything here is column expressions; no Python runs on the executors.

A layout is told by its nested field paths: of the paths that a table or object has, those that a declared layout names are
hashed in order, and the hash is held against that layout's. It is equal if all are there, so further fields do no harm.
Layouts with more paths go first. The one found selects the mapping to turns (role, text).

The template writes a turn as MARK_START role MARK_ROLE text MARK_END. Every string in CONTROLS that occurs in a role or
text gets a backslash after its first character, and backslashes are doubled, so the marks found in a formatted
conversation are the template's own and the texts come back exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

MARK_START, MARK_ROLE, MARK_END = "<|start|>", "<|message|>", "<|end|>"
#: Openings and closings of control strings in public chat templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Layouts: field paths, and the turns they hold. A turn is (role, path of its text); "each" layouts hold an array of turns.
LAYOUTS: dict[str, dict] = {
    "turn rows": {"paths": ["conv_id", "turn", "role", "text"]},
    "prompt and completion": {"paths": ["prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "prompt and response": {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "question and answer": {"paths": ["question", "answer"], "turns": [("user", "question"), ("assistant", "answer")]},
    "instruction": {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction with input": {"paths": ["instruction", "input", "output"], "turns": [("user", "instruction", "input"), ("assistant", "output")]},
    "system, prompt and response": {"paths": ["system", "prompt", "response"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "system, prompt and completion": {"paths": ["system", "prompt", "completion"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    "messages": {"paths": ["messages", "messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations", "conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
}
#: Role names in use, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Fingerprints of the layouts, those with more paths first.
FINGERPRINTS = {fingerprint(x["paths"]): name for name, x in sorted(LAYOUTS.items(), key=lambda kv: -len(kv[1]["paths"]))}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; [] stands for the elements of an array."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            out += [path, *schema_paths(f.dataType, path)]
        return out
    return []


def layouts_of(df: DataFrame) -> list[str]:
    """Names of the declared layouts whose paths a table's schema has, the most specific first."""
    has = set(schema_paths(df.schema))
    return [name for mark, name in FINGERPRINTS.items() if fingerprint([p for p in LAYOUTS[name]["paths"] if p in has]) == mark]


def layout_of(df: DataFrame) -> str | None:
    return next(iter(layouts_of(df)), None)


def json_fingerprint(raw: Column | str) -> Column:
    """Fingerprint of the layout of a JSON object in a string column, from the keys it has; null if it has none declared.

    An array's elements count together: a path is there if any element has it.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    none = F.array().cast("array<string>")

    def below(a: str) -> Column:
        items = F.from_json(F.get_json_object(raw, f"$.{a}"), "array<string>")
        keys = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), none)))
        return F.transform(keys, lambda k: F.concat(F.lit(f"{a}[]."), k))

    nested = [x["each"][0] for x in LAYOUTS.values() if "each" in x]
    keys = F.concat(*[F.coalesce(k, none) for k in (F.json_object_keys(raw), *map(below, nested))])

    def found(has: Column) -> Column:
        mark = lambda name: F.substring(F.sha2(F.array_join(F.array_sort(F.array_intersect(has, F.array(*map(F.lit, LAYOUTS[name]["paths"])))), "\n"), 256), 1, 16)
        return F.coalesce(*[F.when(mark(name) == fp, F.lit(fp)) for fp, name in FINGERPRINTS.items()])

    return F.transform(F.array(keys), found)[0]


def turns_from_json(df: DataFrame, raw_col: str) -> DataFrame:
    """Add layout (name, null if unknown) and turns (array of role, text; null if unknown) to rows of JSON objects.

    A missing or null field is an empty text; unknown role names stay as they are.
    """
    raw, fp = F.col(raw_col), unused(df, "_fp")
    text = lambda path: F.coalesce(F.get_json_object(raw, f"$.{path}"), F.lit(""))
    names = F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv])
    canonical = lambda role: F.coalesce(F.element_at(names, F.coalesce(F.lower(role), F.lit(""))), role, F.lit(""))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for mark, name in FINGERPRINTS.items():
        x = LAYOUTS[name]
        if "turns" in x:
            made = F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*map(text, paths)), lambda t: (t != "") | F.lit(len(paths) == 1)), "\n").alias("text")) for role, *paths in x["turns"]])
        elif "each" in x:
            field, role, said = x["each"]
            parsed = F.from_json(F.get_json_object(raw, f"$.{field}"), f"array<struct<`{role}`:string,`{said}`:string>>")
            made = F.transform(parsed, lambda t: F.struct(canonical(t[role]).alias("role"), F.coalesce(t[said], F.lit("")).alias("text")))
        else:
            continue
        is_it = F.col(fp) == mark
        layout, turns = F.when(is_it, F.lit(name)).otherwise(layout), F.when(is_it, made).otherwise(turns)
    return df.withColumn(fp, json_fingerprint(raw_col)).withColumns({"layout": layout, "turns": turns}).drop(fp)


def turns_from_rows(df: DataFrame) -> DataFrame:
    """conv_id and turns (array of role, text) of a table in a declared layout of rows.

    Turns go by number (null first), then role and text; null roles and texts are empty. Repeated rows stay. Rows
    without a conv_id are one conversation without an id.
    """
    if "turn rows" not in layouts_of(df):
        raise ValueError(f"no declared layout of rows has the fields {df.columns}")
    rows = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return each.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s)


_CONTROL = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROLS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Replace turns by formatted and loss_mask.

    loss_mask has a (turn, at, n) for each turn of a role in learn: n characters from character at (from 0) of that
    turn's part of formatted are to be learnt.
    """
    def turn(t: Column) -> Column:
        return F.concat(F.lit(MARK_START), escaped(t["role"]), F.lit(MARK_ROLE), escaped(t["text"]), F.lit(MARK_END))

    def span(t: Column, i: Column) -> Column:
        at = F.length(escaped(t["role"])) + len(MARK_START + MARK_ROLE)
        return F.when(t["role"].isin(*learn), F.struct(i.alias("turn"), at.alias("at"), F.length(escaped(t["text"])).alias("n")))

    return df.withColumns(
        {"formatted": F.array_join(F.transform("turns", turn), ""), "loss_mask": F.array_compact(F.transform("turns", span))}
    ).drop("turns")


def read_turns(df: DataFrame) -> DataFrame:
    """Add turns (role, text) and learnt (text under the loss mask, unescaped), read from formatted and loss_mask alone."""
    end = _quoted(MARK_END)
    parts = F.filter(F.split("formatted", end, -1), lambda p: p != "")
    cut, by_turn, beside_ = (unused(df, n) for n in ("_parts", "_map", "_spans"))

    def turn(p: Column) -> Column:
        both = F.split(p, _quoted(MARK_ROLE), -1)
        return F.struct(unescaped(F.substring(F.get(both, F.lit(0)), len(MARK_START) + 1, 2**31 - 1)).alias("role"), unescaped(F.get(both, F.lit(1))).alias("text"))

    # The mask's spans are laid beside the parts, so that each part is cut once.
    spans = F.map_from_entries(F.transform("loss_mask", lambda s: F.struct(s["turn"].alias("k"), s.alias("v"))))
    beside = F.transform(F.sequence(F.lit(0), F.size(cut) - 1), lambda i: F.element_at(F.col(by_turn), i))
    learnt = F.zip_with(cut, beside_, lambda p, s: F.coalesce(unescaped(F.substring(p, s["at"] + 1, s["n"])), F.lit("")))
    return (
        df.withColumns({"turns": F.transform(parts, turn), cut: F.split("formatted", end, -1), by_turn: spans})
        .withColumn(beside_, beside)
        .withColumn("learnt", F.array_join(learnt, ""))
        .drop(cut, by_turn, beside_)
    )


def chat_digest(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted output."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_turns(df).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
