"""Scores against labels: counts, calibration, ranking and clustering measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prf(rows: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of p >= threshold against y; null where a denominator is zero."""
    hit = F.col("p") >= threshold
    each = rows.groupBy(*by).agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit).alias("predicted"), F.count_if(F.col("y") == 1).alias("gold"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return each.withColumns({"precision": share(F.col("tp"), F.col("predicted")), "recall": share(F.col("tp"), F.col("gold")), "f1": share(2 * F.col("tp"), F.col("predicted") + F.col("gold"))})


def calibration(rows: DataFrame, *by: str) -> DataFrame:
    """n, expected calibration error over ten bins, and Brier score."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)))
    bins = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.abs(F.sum("p") - F.sum("y")).alias("gap"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum("gap") / F.sum("n"), 6).cast("double").alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).cast("double").alias("brier"))


def contingency(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("p", "g").agg(F.count("*").alias("n"))
    return cells.withColumns({"np": F.sum("n").over(Window.partitionBy("p")), "ng": F.sum("n").over(Window.partitionBy("g"))})


def thread_exact_f1(rows: DataFrame) -> DataFrame:
    """Clusters that are the same set on both sides, as F1 over the numbers of clusters."""
    return contingency(rows).agg(
        F.count_if((F.col("n") == F.col("np")) & (F.col("n") == F.col("ng"))).alias("exact"), F.countDistinct("p").alias("predicted"), F.countDistinct("g").alias("gold")
    ).withColumn("f1", F.round(2.0 * F.col("exact") / (F.col("predicted") + F.col("gold")), 6))


def ari(rows: DataFrame) -> DataFrame:
    """Adjusted Rand index; 1 where it is not defined, within -1 and 1."""
    two = lambda c: c * (c - 1) / 2.0
    cells = rows.groupBy("p", "g").agg(F.count("*").alias("n"))
    c = cells.agg(F.sum(two(F.col("n"))).alias("c"), F.sum("n").alias("all"))
    a = rows.groupBy("p").agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    b = rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    one = c.join(a).join(b)  # one row each
    expected = F.col("a") * F.col("b") / F.nullif(two(F.col("all")), F.lit(0.0))
    top = (F.col("a") + F.col("b")) / 2.0
    value = F.when(F.coalesce(top - expected, F.lit(0.0)) == 0, 1.0).otherwise((F.col("c") - expected) / F.nullif(top - expected, F.lit(0.0)))
    return one.select(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), 6).alias("ari"))


def nmi(rows: DataFrame) -> DataFrame:
    """Normalized mutual information by the arithmetic mean; 1 without entropy, within 0 and 1."""
    n = F.col("total")
    total = rows.agg(F.count("*").cast("double").alias("total"))
    h = lambda k: rows.groupBy(k).agg(F.count("*").alias("n")).join(total).agg(F.sum(-F.col("n") / n * F.ln(F.col("n") / n)).alias(f"h{k}"))
    mutual = contingency(rows).join(total).agg(F.sum(F.col("n") / n * F.ln(F.col("n") * n / (F.col("np") * F.col("ng")))).alias("mi"))
    one = mutual.join(h("p")).join(h("g"))
    mean = (F.col("hp") + F.col("hg")) / 2.0
    value = F.when(mean == 0, 1.0).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0)))
    return one.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("nmi"))


def ndcg(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """NDCG@k of rows with place (from 1) and rel; gain 2^rel - 1; the ideal is over all rows; null without gain."""
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rel"), "place"))
    gain = lambda place: F.when(place <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(place + 1.0)).otherwise(0.0)
    each = rows.withColumn("best", ideal).groupBy(*by).agg(F.sum(gain(F.col("place"))).alias("dcg"), F.sum(gain(F.col("best"))).alias("idcg"))
    return each.select(*by, F.round(F.try_divide(F.col("dcg"), F.col("idcg")), 6).alias("ndcg"))


def top_recall(rows: DataFrame, k: int, rel: int, *by: str) -> DataFrame:
    """Share of the rows with relevance rel that are among the first k."""
    each = rows.groupBy(*by).agg(F.count_if((F.col("rel") == rel) & (F.col("place") <= k)).alias("found"), F.count_if(F.col("rel") == rel).alias("gold"))
    return each.withColumn("recall", F.round(F.try_divide(F.col("found").cast("double"), F.col("gold")), 6))
