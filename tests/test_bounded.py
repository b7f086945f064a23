"""Steps whose rounds or groups must not grow with the table."""

from murmuration.operators import gold
from murmuration.operators.graph import match_greedy


def test_greedy_chain_ends_after_few_rounds(spark):
    """Each pair waits for the one before it: a round a pair."""
    rows = [("r", i // 2, (i + 1) // 2, 100 - i, 0) for i in range(60)] + [("s", 1, 2, 5, 0), ("s", 1, 3, 4, 0)]
    df = spark.createDataFrame(rows, "run string, pred long, gold long, overlap long, rank long")
    spark.sparkContext.setJobGroup("greedy-chain", "match_greedy")
    try:
        got = {tuple(r) for r in match_greedy(df, at_once=0).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy-chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {("r", i // 2, i // 2, 100 - i) for i in range(0, 60, 2)} | {("s", 1, 2, 5)} and jobs < 60


def test_repeated_item_ids_are_not_collected(spark):
    msg = spark.createDataFrame([(f"m_{i:016x}", i, "u", "u", "t", False) for i in range(9)], "message_id string, sent_at long, sender string, sender_display string, display_text string, recalled boolean")
    source = gold.sheet(msg)
    item = """concat('[{"item_id":"', IF(message_id < 'm_0000000000000006', 'same', message_id), '","kind":"todo","assignee":"all","anchors":["', message_id, '"],"importance":"P2","deadline":null}]')"""
    out = gold.sheet_problems(source.selectExpr(*gold.SHEET[:6], "'t' AS thread", "'true' AS todo", "'true' AS announcement", f"{item} AS items_json"), source)
    assert sorted((r.message_id, r.rule) for r in out.collect()) == [(f"m_{i:016x}", "item id is repeated") for i in range(6)]
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
