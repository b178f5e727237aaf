"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR chooses the data folder, BENCH_CPUS the cores, BENCH_RUNS the timed runs per
query (after one warm-up; the median counts). BENCH_DUCKDB=1 adds the time DuckDB takes for
the equivalent SQL on the same files and cores.
"""

from __future__ import annotations

import glob
import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablemill.session import local_session  # noqa: E402
from workload import all_cases  # noqa: E402

HEADLINE = (
    "filter_compare", "filter_date_native", "filter_date_text", "case_row", "join_left", "join_multi_key", "join_chain",
    "join_left_split", "agg_functions", "agg_count_distinct", "agg_case", "top_groups", "sort_limit", "page_total",
    "report_pivot", "report_grand_total", "family_branch_limit", "enrich_join", "enrich_stats", "enrich_monthly",
    "csv_set_union", "csv_to_parquet_tree", "merge_outer_union",
)


def median_seconds(action, runs: int) -> float:
    action()
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        action()
        times.append(time.perf_counter() - began)
    return statistics.median(times)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench", int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    cases = all_cases()
    names = sys.argv[1:] or HEADLINE
    # The noop sink computes every row without bringing it to the driver.
    times = {
        name: round(
            median_seconds(lambda: cases[name].run(spark, folder).write.format("noop").mode("overwrite").save(), runs), 3
        )
        for name in names
    }
    scale = re.search(r"sf([0-9.]+)$", folder)
    result = {
        "metric": "headline queries, total of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale[1]) if scale else folder,
        "cores": int(cores),
        "shuffle_partitions": int(cores),
        "runs": runs,
    }
    if os.environ.get("BENCH_DUCKDB"):
        import duckdb

        db = duckdb.connect(config={"threads": int(cores)})
        for path in glob.glob(f"{folder}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        result["duckdb"] = {
            name: round(median_seconds(lambda: db.sql(cases[name].sql).to_arrow_table(), runs), 3) for name in names if cases[name].sql
        }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
