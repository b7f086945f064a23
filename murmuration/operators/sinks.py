"""Results as they are exported: tagged sections of an overview, nested calibration reports, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of an overview, in order.
SECTIONS = ("hot_topics", "priority_topics", "related", "mentions", "deadlines", "unread_topics", "resources", "topics", "insights")
TAGGED = "chat string, section string, place long, row string"


def tagged_sections(sections: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """chat, section, place (from 1 in the section), row (JSON of all but chat): one table of differently shaped rows.

    sections: name -> (rows with chat, columns of their order). Names beyond SECTIONS are refused; a section may be absent.
    """
    from pyspark.sql import Window

    out = None
    for name, (rows, order) in sections.items():
        if name not in SECTIONS:
            raise ValueError(f"unknown section {name}")
        body = F.to_json(F.struct(*[c for c in rows.columns if c != "chat"]), {"ignoreNullFields": "false"})
        place = F.row_number().over(Window.partitionBy("chat").orderBy(*order)).cast("bigint")
        one = rows.select(F.col("chat").cast("string").alias("chat"), F.lit(name).alias("section"), place.alias("place"), body.alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def write_sections(tagged: DataFrame, path: str) -> None:
    """A folder a section, so that a reader of one touches no other."""
    tagged.write.partitionBy("section").json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """chat, section, place, row (VARIANT), header (how many rows the chat has in each section)."""
    rows = spark.read.schema(TAGGED).json(path)
    counts = rows.groupBy("chat", "section").agg(F.count("*").alias("n")).groupBy("chat").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("header"))
    return rows.withColumn("row", F.parse_json("row")).join(counts, "chat")


def calibration_report(samples: DataFrame, bins: int = 10) -> DataFrame:
    """One row: version, status, bins, total, included, excluded (map of reason to number), groups (array, by model and task).

    samples: model, task, p, y, excluded (null where it counts). A group has count, ece, brier and its bins (bin, count,
    positives, mean). Bins are summed per group before anything is nested.
    """
    used = samples.where("excluded IS NULL").withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    each = used.groupBy("model", "task", "bin").agg(F.count("*").alias("count"), F.sum("y").cast("bigint").alias("positives"), F.sum("p").alias("sum"), F.sum((F.col("p") - F.col("y")) ** 2).alias("squares"))
    bin_ = F.struct("bin", "count", "positives", F.round(F.col("sum") / F.col("count"), 6).alias("mean"))
    group = each.groupBy("model", "task").agg(
        F.sum("count").alias("count"), F.round(F.sum(F.abs(F.col("sum") - F.col("positives"))) / F.sum("count"), 6).alias("ece"), F.round(F.sum("squares") / F.sum("count"), 6).alias("brier"), F.array_sort(F.collect_list(bin_)).alias("bins"))
    groups = group.agg(F.array_sort(F.collect_list(F.struct("model", "task", "count", "ece", "brier", "bins"))).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("included"))
    reasons = samples.where("excluded IS NOT NULL").groupBy("excluded").agg(F.count("*").alias("n"))
    gone = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("excluded", "n")))).alias("excluded"), F.coalesce(F.sum("n"), F.lit(0)).alias("left"))
    one = lambda d: d.withColumn("_", F.lit(0))
    both = one(groups).join(one(gone), "_")  # a row each
    status = F.when(F.col("included") == 0, "unavailable_no_labels").otherwise("ok")
    return both.select(F.lit(1).alias("calibration_version"), status.alias("status"), F.lit(bins).alias("bins"), (F.col("included") + F.col("left")).alias("total"), "included", "excluded", "groups")


REPORT = "calibration_version int, status string, bins int, total long, included long, excluded map<string,long>, groups array<struct<model:string,task:string,count:long,ece:double,brier:double,bins:array<struct<bin:long,count:long,positives:long,mean:double>>>>"


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """model, task, count, ece, brier, bin, n, positives, mean: a row a bin, with what the report says of the whole."""
    rows = spark.read.schema(REPORT).json(path).select("status", "total", "included", "excluded", F.explode("groups").alias("g")).select("*", "g.*")
    return rows.drop("g").withColumn("b", F.explode("bins")).select("model", "task", "count", "ece", "brier", "b.bin", F.col("b.count").alias("n"), "b.positives", "b.mean", "total", "included")
