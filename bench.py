"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data directory, ``BENCH_CPUS`` the local threads.
Each query runs to a sink that discards rows; the first run warms the JVM up
and the best of three runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staytide import registry  # noqa: E402
from staytide.plans import kidney  # noqa: E402
from staytide.sources.fixtures import stay_tables  # noqa: E402

HEADLINE = [
    "creatinine_baseline", "creatinine_baseline_split", "stage_7day_creatinine", "weight_durations",
    "urine_trailing", "urine_trailing_split", "stage_urine", "stages_all_times", "stage_48h",
    "stage_7day", "lab_pivot", "vitals_pivot", "note_fields", "comorbidities", "admission_info",
    "cohort_wide", "feature_matrix_urine", "split_exact", "standardize_by_group", "class_report",
    "roc_auc",
]


def creatinine_self_join(spark: SparkSession, sf_dir: str):
    """The baseline as two range self joins, to compare with the windows."""
    t = stay_tables(spark, sf_dir)
    series = kidney.creatinine_series(t.icustays, t.labevents, "inner")
    result = series
    for name, span in (("48hr", timedelta(hours=48)), ("7day", timedelta(days=7))):
        past = series.select(F.col("icustay_id").alias("k"), F.col("charttime").alias("past"),
                             F.col("creat").alias("v"))
        on = ((F.col("icustay_id") == F.col("k")) & (F.col("past") < F.col("charttime"))
              & (F.col("past") >= F.col("charttime") - F.lit(span)))
        low = (series.join(past, on, "left").groupBy("icustay_id", "charttime", "creat")
               .agg(F.min("v").alias(f"creat_low_past_{name}")))
        result = result.join(low, ["icustay_id", "charttime", "creat"])
    return result.distinct()


def seconds(run) -> float:
    best = float("inf")
    for _ in range(3):
        begin = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - begin)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    runs = {name: registry.QUERIES[name] for name in HEADLINE}
    runs["creatinine_self_join"] = creatinine_self_join
    queries = {name: seconds(lambda: run(spark, sf_dir)) for name, run in runs.items()}
    total = round(sum(v for k, v in queries.items() if k != "creatinine_self_join"), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
