"""Command line: ``python -m tidemark.cli COMMAND``. Exit code 0: done or verified, 1: the check failed, 2: usage."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.analytics import Phases
from tidemark.operators.merge import merge_runs, write_ordered
from tidemark.operators.verify import compare_files, equal_bag, verify_records
from tidemark.plans import chunking
from tidemark.schema import HEADER_BYTES
from tidemark.sources import gen, kvbin
from tidemark.sources.parts import delete_path, file_bytes


def output_name(path: str, tag: str = "sorted") -> str:
    """``dir/x.bin`` -> ``dir/x_sorted_output.bin``."""
    stem, ext = os.path.splitext(path)
    return f"{stem}_{tag}_output{ext}"


def session(threads: int) -> SparkSession:
    """The running session, or a local one of ``threads`` threads."""
    return SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{threads}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _sort(a, spark) -> int:
    out = a.output or output_name(a.file)
    clock = Phases()
    split = max(1 << 20, chunking.threaded_chunk(max(1, file_bytes(a.file)), a.mb << 20, a.threads))
    with clock.phase("sort"):
        df = kvbin.read_records(spark, a.file, ["sort_key", "file_id", "offset", "payload"], splitBytes=split)
        write_ordered(df, out, ["sort_key"], ["file_id", "offset"], fmt="kvbin", single_file=a.single)
    if a.command == "benchmark":
        print(f"File={a.file} Threads={a.threads} Memory={a.mb} Time={clock.total:.4f}")
        if not a.keep:
            delete_path(out)
        return 0
    order = verify_records(spark, out)
    same = equal_bag(*[kvbin.read_records(spark, p).select("sort_key", "payload") for p in (a.file, out)])
    print(f"{'PASS' if order.ok and same else 'FAIL'}: {order.rows} records, {order.inversions} inversions, same records: {same}; {out}")
    return int(not (order.ok and same))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, unit in (("gen_count", "n"), ("gen_size", "mb")):
        c = sub.add_parser(name)
        c.add_argument("file")
        c.add_argument(unit, type=int)
        c.add_argument("len", type=int, nargs="?", default=100)
        c.add_argument("--seed", type=int, default=1)
    for name in ("verify", "delete"):
        sub.add_parser(name).add_argument("file")
    c = sub.add_parser("compare")
    c.add_argument("file")
    c.add_argument("other")
    for name in ("sort", "benchmark"):
        c = sub.add_parser(name)
        c.add_argument("file")
        c.add_argument("mb", type=int, nargs="?", default=256)
        c.add_argument("threads", type=int, nargs="?", default=4)
        c.add_argument("--output")
        c.add_argument("--single", action="store_true", help="one output file")
        c.add_argument("--keep", action="store_true", help="keep the output of a benchmark")
    c = sub.add_parser("merge", help="sorted record files into one ordered output")
    c.add_argument("output")
    c.add_argument("runs", nargs="+")
    c = sub.add_parser("plan")
    c.add_argument("file")
    c.add_argument("threads", type=int, nargs="?", default=4)
    a = p.parse_args(argv)

    if a.command == "delete":
        return int(not delete_path(a.file))
    spark = session(getattr(a, "threads", 4))
    try:
        if a.command in ("gen_count", "gen_size"):
            df = gen.gen_count(spark, a.n, a.len, a.seed) if a.command == "gen_count" else gen.gen_size(spark, a.mb << 20, a.len, a.seed)
            kvbin.write_records(df, a.file)
            return 0
        if a.command == "verify":
            order = verify_records(spark, a.file)
            print(f"{'PASS' if order.ok else 'FAIL'}: {order.rows} records, first bad position {order.first_bad}")
            return int(not order.ok)
        if a.command == "compare":
            same = compare_files(spark, a.file, a.other)
            print("equal" if same else "different")
            return int(not same)
        if a.command == "merge":
            columns = ["sort_key", "payload", "file_id", "offset"]
            runs = [kvbin.read_records(spark, p, columns).withColumn("run", F.lit(i)) for i, p in enumerate(a.runs)]
            kvbin.write_records(merge_runs(runs, ["sort_key"], ["run", "file_id", "offset"]), a.output)
            order = verify_records(spark, a.output)
            print(f"{'PASS' if order.ok else 'FAIL'}: {order.rows} records; {a.output}")
            return int(not order.ok)
        if a.command == "plan":
            sizes = kvbin.read_records(spark, a.file, ["file_id", "offset", "len"]).select("file_id", "offset", (F.col("len") + HEADER_BYTES).cast("bigint").alias("size"))
            plan = chunking.plan_chunks(sizes, ["file_id", "offset"], "size", chunking.preset(a.threads), [])
            print(f"chunk {plan.chunk_bytes} bytes, {len(plan.chunks)} chunks, fan-out {plan.fanout}, io bound {plan.io_bound}")
            return 0
        return _sort(a, spark)
    except (FileNotFoundError, ValueError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
