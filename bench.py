"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores; BENCH_QUERIES picks queries by name.
Each query runs to the end into a sink that drops the rows. The genome view is stored and packed once
beforehand, as a genome would be.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "merge_intervals overlap_join exclude_overlaps extract_windows gc_matched_negatives variant_windows kmer_counts "
    "dinuc_shuffle scan_motifs hit_pvalues best_window mutagenesis variant_effect filter_summary roc_auc pr_auc "
    "score_regression effect_summary balance_scores split_dataset match_events variant_validation method_comparison "
    "count_benchmark peak_set_validation"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from lociframe.queries import QUERIES
    from lociframe.queries.views import Views
    Views(spark, sf_dir).packed
    QUERIES["merge_intervals"](spark, sf_dir).count()   # starts the engine; its first run is not the first timing

    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cores}
    if "merge_intervals" in seconds:
        out["merge_rows_per_sec"] = round(rows / seconds["merge_intervals"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
