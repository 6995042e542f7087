"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("search_whitespace_bm25", "search_trigram", "dense_cosine", "hybrid_rrf", "hybrid_linear", "hybrid_filtered", "facet_counts", "group_refetch", "join_meta", "multi_query_benchmark", "ingest_latest_wins", "ingest_fold_upsert_delete", "metrics_1m", "metrics_sliding_60s", "fetch_page_1")


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from marlstone.plans.queries import QUERIES

    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles and builds what a collection keeps; the median of all counts
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
