"""Deadline phrases: generated from parts, each with what a plain normaliser makes of the parts."""

import datetime
import itertools

import pytest

from murmuration.functions.deadline import normalize

DAYS = [("", None), ("今天", 0), ("明天", 1), ("后天", 2), ("大后天", 3)]
CLOCKS = [
    ("", None, None, None), ("上午11点", 11, 0, "hour"), ("晚上7点", 19, 0, "hour"), ("下午4点20分", 16, 20, "minute"), ("早上六点半", 6, 30, "minute"),
    ("17:45", 17, 45, "minute"), ("二十点", 20, 0, "hour"), ("中午12点", 12, 0, "hour"),
]
TAILS = [("", "at"), ("前", "before"), ("之前", "before"), ("之后", "after"), ("以后", "after")]
HEADS = [("", None), ("截止", "before"), ("ddl", "before")]
#: The last day of a month in a leap year, and the last of a year.
ANCHORS = [datetime.date(2024, 2, 29), datetime.date(2027, 12, 31)]


def plain():
    for (head, by_head), (day, ahead), (clock, hour, minute, part), (tail, relation) in itertools.product(HEADS, DAYS, CLOCKS, TAILS):
        if not day and not clock or head and tail:
            continue
        yield head + day + clock + tail, ahead or 0, None if hour is None else hour * 3600 + minute * 60, by_head or relation, part or "day"


def test_generated_phrases(spark):
    want = {p[0]: p[1:] for p in plain()}
    rows = [(raw, anchor) for raw in want for anchor in ANCHORS]
    got = {(r.raw, r.local_date): r for r in normalize(spark.createDataFrame(rows, "raw string, local_date date")).collect()}
    bad = []
    for raw, anchor in rows:
        ahead, sec, relation, part = want[raw]
        r = got[raw, anchor]
        if (r.bound_date, r.bound_sec, r.relation, r.granularity) != (anchor + datetime.timedelta(ahead), sec, relation, part) or float(r.confidence) < 0.9:
            bad.append((raw, anchor, r))
    assert len(want) > 150 and not bad


WEEKDAYS = "一二三四五六日"


def test_weekdays(spark):
    """A weekday of this week or the next; one without a word is the next to come, today included."""
    want = {}
    for anchor in ANCHORS:
        monday = anchor - datetime.timedelta(anchor.weekday())
        for k, name in enumerate(WEEKDAYS):
            for week in ("周", "星期", "礼拜"):
                want[f"下{week}{name}", anchor] = monday + datetime.timedelta(7 + k)
                want[f"这{week}{name}", anchor] = monday + datetime.timedelta(k)
                want[f"{week}{name}前", anchor] = anchor + datetime.timedelta((k - anchor.weekday()) % 7)
    got = {(r.raw, r.local_date): r for r in normalize(spark.createDataFrame(list(want), "raw string, local_date date")).collect()}
    assert {k: got[k].bound_date for k in want} == want
    assert all((float(got[k].confidence) < 0.9) == (k[0][0] == "这" and d < k[1]) for k, d in want.items())


def test_days_of_months(spark):
    """A day of the month is this month's if it is not long past, else the next month's that has it; a date likewise by year."""
    rows = [("5天内", 5), ("十二天后", 12), ("0天后", 0)]
    for anchor in ANCHORS:
        got = {r.raw: r for r in normalize(spark.createDataFrame([(raw, anchor) for raw, _ in rows], "raw string, local_date date")).collect()}
        assert {raw: got[raw].bound_date for raw, _ in rows} == {raw: anchor + datetime.timedelta(n) for raw, n in rows}
    leap = spark.createDataFrame([("3月1日", ANCHORS[0]), ("2月30日", ANCHORS[0]), ("1月1日", ANCHORS[1]), ("12月31号", ANCHORS[1])], "raw string, local_date date")
    assert {r.raw: r.bound_date and str(r.bound_date) for r in normalize(leap).collect()} == {"3月1日": "2024-03-01", "2月30日": None, "1月1日": "2028-01-01", "12月31号": "2027-12-31"}


def test_no_deadline(spark):
    vague = ["", "改天", "下午", "30点", "4月31日", "7天", "明天后天", "周八", "99号"]
    got = normalize(spark.createDataFrame([(v, ANCHORS[0]) for v in vague], "raw string, local_date date")).collect()
    assert {(r.bound_date, r.bound_sec, r.granularity, float(r.confidence)) for r in got} == {(None, None, "unknown", 0.0)}


@pytest.mark.parametrize("text,found", [("[图片]", None), ("[foo [图片] x", "[foo[图片]x"), ("a [表情:1] b", "ab"), ("...", None)])
def test_meaningful_text(spark, text, found):
    from pyspark.sql import functions as F

    from murmuration.functions.text import meaningful_text

    assert spark.createDataFrame([(text,)], "t string").select(meaningful_text(F.col("t"))).first()[0] == found
