"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from murmuration.queries import HEADLINE, QUERIES


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    spark.read.parquet(f"{sf}/events.parquet").count()
    for name in HEADLINE:
        best = []
        for _ in range(2):
            t = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.time() - t)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
