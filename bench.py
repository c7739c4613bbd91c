"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark.operators.verify import verify_records
from tidemark.queries import QUERIES
from tidemark.sources import gen, kvbin

HEADLINE = ["sort_full", "merge_runs", "sort_events_dupkeys", "compare_bag", "verify_sorted", "size_stats", "even_split", "topk"]
RUNS = 5
RECORDS = int(os.environ.get("BENCH_RECORDS", 1_000_000))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="tidemark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{tmp}/checkpoint")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    cold: dict[str, float] = {}

    def clock(name, f):
        a = time.perf_counter()
        f()
        cold[name] = round(time.perf_counter() - a, 4)
        took = []
        for _ in range(RUNS):
            a = time.perf_counter()
            f()
            took.append(time.perf_counter() - a)
        times[name] = round(statistics.median(took), 4)

    for q in HEADLINE:
        clock(q, lambda q=q: QUERIES[q](spark, sf).write.format("noop").mode("overwrite").save())
    # The record format end to end: scan, sort, write; records of 64 bytes (BENCH_RECORDS=10000000 is a published size).
    src, dst = f"{tmp}/records", f"{tmp}/sorted"
    kvbin.write_records(gen.gen_count(spark, RECORDS, 64), src)

    def record_sort():
        df = kvbin.read_records(spark, src, ["sort_key", "payload", "file_id", "offset"], splitBytes=16 << 20)
        kvbin.write_records(df.orderBy("sort_key", "file_id", "offset"), dst)

    clock(f"record_sort_{RECORDS // 1_000_000}M_p64", record_sort)
    order = verify_records(spark, dst)
    assert order.ok and order.rows == RECORDS, order
    spark.stop()
    shutil.rmtree(tmp)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
