"""Deadline phrases to dates: one pass of regular expressions and small lookup maps per distinct phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the phrase grammar.
BEFORE_HEAD = "截止|截至|ddl"
TAILS = {"之前": "before", "以前": "before", "以内": "before", "前": "before", "内": "before", "之后": "after", "以后": "after", "后": "after"}
DAYS = {"今天": 0, "明天": 1, "后天": 2, "大后天": 3, "今早": 0, "今晚": 0, "明早": 1, "明晚": 1}
WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
PERIODS = {"早": "am", "上午": "am", "早上": "am", "晚": "pm", "下午": "pm", "晚上": "pm", "中午": "noon"}
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}

_N = "[0-9]{1,2}|[零一二两三四五六七八九]?十[一二三四五六七八九]?|[零一二两三四五六七八九]"
_DATE = (
    rf"(?:(大后天|后天|明天|今天|明(?=[早晚])|今(?=[早晚]))|(下个?|这|本)?(?:星期|周|礼拜)([一二三四五六日天])"
    rf"|({_N})月({_N})[日号]|({_N})号|({_N})天)?"
)
_CLOCK = rf"(上午|早上|下午|晚上|中午|早|晚)?(上午|早上|下午|晚上|中午)?(?:({_N})(点)(?:(半)|({_N})分)?|({_N})[:：]({_N}))?"
PHRASE = rf"^{_DATE}{_CLOCK}$"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _number(c: Column) -> Column:
    """Value of a numeral of one to three signs; null for an empty string."""
    digit = lambda s: F.coalesce(F.element_at(_map(NUMERALS), s), F.lit(0))
    tens = F.when(F.substring_index(c, "十", 1) == "", 1).otherwise(digit(F.substring_index(c, "十", 1)))
    return F.when(c == "", None).when(c.rlike("^[0-9]+$"), c.try_cast("int")).when(c.contains("十"), tens * 10 + digit(F.substring_index(c, "十", -1))).otherwise(digit(c))


def normalize(phrases: DataFrame) -> DataFrame:
    """Add relation, bound_date, bound_sec, granularity, confidence to distinct (raw, local_date).

    The whole phrase must fit the grammar, else all bounds are null, granularity is unknown and confidence 0. A bare
    weekday is the next one on or after the date; this week's may be past (confidence 0.5); day and month roll on when
    more than a week past. Bare hours 1 to 6 are afternoon, hours 1 to 11 without a period have confidence 0.6.
    """
    x = F.lower(F.regexp_replace("raw", r"(?U)\s", ""))
    head = x.rlike(rf"^(?:{BEFORE_HEAD})")
    x = F.regexp_replace(x, rf"^(?:{BEFORE_HEAD})[:：]?", "")
    tails = "(?:" + "|".join(sorted(TAILS, key=len, reverse=True)) + ")$"
    rows = phrases.withColumns({"head": head, "x": x}).withColumn("tail", F.regexp_extract("x", tails, 0))
    rows = rows.withColumn("body", F.expr("IF(tail <> '', left(x, length(x) - length(tail)), x)"))
    group = lambda i: F.regexp_extract("body", PHRASE, i)
    rows = rows.withColumns({n: group(i + 1) for i, n in enumerate("day week weekday month mday dom span p1 p2 hour point half minute hour2 minute2".split())})
    marked = F.element_at(_map(TAILS), F.col("tail"))
    rows = rows.withColumns({k: _number(F.col(k)) for k in ("month", "mday", "dom", "span", "hour", "minute", "hour2", "minute2")})
    d, n = F.col("local_date"), F.element_at(_map(WEEKDAYS), F.col("weekday"))
    delta = n - F.weekday(d)
    delta = F.when(F.col("week").startswith("下"), delta + 7).when(F.col("week") != "", delta).otherwise(F.pmod(delta, F.lit(7)))
    day = F.when(F.col("day").isin("明", "今"), F.when(F.col("day") == "明", 1).otherwise(0)).otherwise(F.element_at(_map(DAYS), F.col("day")))
    made = lambda y, m, k: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, k), "yyyy-MM-dd")
    own, next_year = made(F.year(d), F.col("month"), F.col("mday")), made(F.year(d) + 1, F.col("month"), F.col("mday"))
    this, later = made(F.year(d), F.month(d), F.col("dom")), F.add_months(F.trunc(d, "month"), 1)
    date = (
        F.when(F.col("day") != "", F.date_add(d, day))
        .when(F.col("weekday") != "", F.date_add(d, delta))
        .when(F.col("month").isNotNull(), F.when(F.datediff(d, own) > 7, next_year).otherwise(own))
        .when(F.col("dom").isNotNull(), F.when(F.datediff(d, this) > 7, made(F.year(later), F.month(later), F.col("dom"))).otherwise(this))
        .when(F.col("span").isNotNull(), F.date_add(d, F.col("span")))
    )
    rows = rows.withColumn("date", date)
    has = (F.col("day") != "") | (F.col("weekday") != "") | F.col("month").isNotNull() | F.col("dom").isNotNull() | F.col("span").isNotNull()
    a, b = F.element_at(_map(PERIODS), F.col("p1")), F.element_at(_map(PERIODS), F.col("p2"))
    period, h, m = F.coalesce(b, a), F.coalesce("hour", "hour2"), F.coalesce(F.when(F.col("half") != "", 30), F.col("minute"), F.col("minute2"), F.when(F.col("hour").isNotNull(), 0))
    bare = period.isNull() & (F.col("point") != "") & h.between(1, 11)
    h24 = F.when((period == "pm") & (h < 12), h + 12).when(bare & (h <= 6), h + 12).otherwise(h)
    ok = (F.col("body") != "") & F.col("body").rlike(PHRASE) & ~(F.col("head") & (F.coalesce(marked, F.lit("")) == "after"))
    ok &= ~has | F.col("date").isNotNull()
    ok &= (F.col("p2") == "") | (F.coalesce(a == b, F.lit(False)) & F.col("p1").isin("早", "晚") & F.col("day").isin("明", "今"))
    ok &= ~F.col("p1").isin("早", "晚") | F.col("day").isin("明", "今")
    ok &= F.col("span").isNull() | (F.col("tail").isin("后", "之后", "以后", "内", "以内") & F.col("body").endswith("天"))
    ok &= h.isNull() | ((h <= 23) & (m <= 59) & ~((F.coalesce(period, F.lit("")) == "noon") & (h != 12)))
    ok &= h.isNotNull() | has
    sure = F.when((F.col("week").isin("这", "本")) & (F.col("date") < d), 0.5).otherwise(0.9)
    confidence = F.least(F.when(has, sure).otherwise(0.9), F.when(bare, 0.6).otherwise(0.9))
    part = F.when(h.isNull(), F.when(period.isNotNull(), "half_day").otherwise("day")).when((F.col("half") == "") & F.col("minute").isNull() & F.col("hour2").isNull(), "hour").otherwise("minute")
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    keep = lambda c: F.when(F.col("ok"), c)
    return rows.select(
        *phrases.columns,
        F.coalesce(marked, F.when(F.col("head"), "before"), F.lit("at")).alias("relation"),
        keep(F.when(has, F.col("date")).otherwise(d)).alias("bound_date"),
        keep(h24 * 3600 + m * 60).alias("bound_sec"),
        F.coalesce(keep(part), F.lit("unknown")).alias("granularity"),
        F.coalesce(keep(confidence), F.lit(0.0)).alias("confidence"),
    )
