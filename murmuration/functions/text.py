"""Column expressions on message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of bracketed placeholders that carry no text.
PLACEHOLDERS = ("图片", "文件", "语音", "视频", "合并转发", "表情", "系统", "system", "json", "location")
#: Characters that end a link, besides white space, and that are cut from its end.
LINK_STOPS, LINK_TAIL = "<>\"'，。；！？）】」』", ".,;)]"


def meaningful_text(text: Column) -> Column:
    """Text without placeholders and white space; null if no letter or digit is left."""
    named = "|".join(PLACEHOLDERS)
    visible = F.regexp_replace(F.regexp_replace(text, rf"\[(?:{named})(?::[^\]]*)?\]|(\[[^\]]*\])", "$1"), r"(?U)\s", "")
    return F.when(visible.rlike(r"[\p{IsAlphabetic}\p{N}]"), visible)


def links(text: Column) -> Column:
    """Distinct http and https links of a text, sorted."""
    found = F.regexp_extract_all(text, F.lit(rf"(?U)https?://[^\s{LINK_STOPS}]*"), F.lit(0))
    cut = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;)\]]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda u: F.octet_length(u) > 8)))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def quote_found(text: Column, quote: Column) -> Column:
    """Whether a quote occurs in a text, white space aside; a blank quote never does."""
    q = squeezed(quote)
    return (q != "") & F.contains(squeezed(text), q)


def quote_span(text: Column, quote: Column) -> Column:
    """struct<at, until> of a quote's first place in a text, in characters of the text as it is; null if there is none."""
    q = squeezed(quote)
    seen = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: ~F.substr(text, i, F.lit(1)).rlike(r"(?U)^\s$"))
    start = F.position(q, squeezed(text))
    ends = F.struct((F.element_at(seen, start) - 1).alias("at"), F.element_at(seen, start + F.length(q) - 1).alias("until"))
    return F.when((q != "") & (start > 0), ends)
