"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import queries_records
from tidemark.functions import analytics, timings
from tidemark.operators import merge, sort, verify
from tidemark.plans import chunking
from tidemark.schema import as_records, in_domain, record_bytes
from tidemark.shared import shared_dir

LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI = ", ".join(LINEITEM)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sort_full(spark, d):
    return sort.with_position(table(spark, d, "lineitem").select(*LINEITEM), LINEITEM)


def sort_events_dupkeys(spark, d):
    return sort.with_position(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


def sort_desc_multi(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_custkey")
    return sort.with_position(df, ["o_totalprice", "o_orderkey"], ["o_custkey"], descending=["o_totalprice"])


def topk(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_custkey")
    return sort.top_k(df, 100, ["o_totalprice", "o_orderkey"], [], descending=["o_totalprice"])


def runs_by_key(spark, d):
    return sort.runs_by_key(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 8, ["o_custkey", "o_totalprice"])


def merge_runs(spark, d):
    """Sorted runs, stored as the first pass of an external sort leaves them, and merged."""
    runs = sort.local_runs(table(spark, d, "lineitem").select(*LINEITEM), 4, LINEITEM, [])
    merged = merge.merge_runs(sort.store_runs(runs, shared_dir(spark, "runs")), LINEITEM, [])
    return sort.with_position(merged, LINEITEM)


def union_bag(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    line = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("orderkey"))
    return merge.union_bag([o, line, o])


def compare_bag(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    parts = []
    for case, other in (("same", o), ("mutated", o.filter("o_orderpriority <> '1-URGENT'"))):
        diff = verify.bag_difference(o, other)
        parts.append(diff.agg(F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)).cast("bigint").alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_b")).select(F.lit(case).alias("case_name"), "only_a", "only_b"))
    return merge.union_bag(parts)


def compare_ordered(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    a = sort.with_position(e, ["user_id"], ["event_id"])
    b = sort.with_position(e, ["user_id", "event_id"], [], descending=["event_id"])
    one = verify.ordered_mismatches(a, b).agg(F.count(F.lit(1)).alias("mismatches")).select(F.lit("flipped").alias("case_name"), "mismatches")
    two = verify.ordered_mismatches(a, a).agg(F.count(F.lit(1)).alias("mismatches")).select(F.lit("same").alias("case_name"), "mismatches")
    return one.unionAll(two)


def verify_sorted(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    done = verify.verify_sorted(sort.global_sort(e, ["user_id"], ["event_id"]), ["user_id"])
    raw = verify.verify_sorted(e.orderBy("event_id"), ["user_id"])
    rows = [("sorted", done.rows, done.inversions), ("by_event", raw.rows, raw.inversions)]
    return spark.createDataFrame(rows, "case_name string, n bigint, inversions bigint")


def record_projection(spark, d):
    r = as_records(table(spark, d, "events"), "user_id", "props")
    return r.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"), F.min("sort_key").alias("sort_key")).select(F.col("key").cast("bigint").alias("key"), "n", "bytes", "sort_key")


def filter_domain(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(in_domain(F.octet_length("text"))).select("doc_id", F.octet_length("text").cast("bigint").alias("len"))


def record_size(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", record_bytes(F.col("text")).alias("total_size"))


def size_stats(spark, d):
    s = chunking.size_stats(record_size(spark, d).withColumnRenamed("total_size", "size"))
    return s.withColumn("size_variance", F.round("size_variance", 3))


def running_bytes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.octet_length("text") + 12).alias("sz"))
    return chunking.running_bytes(docs, ["doc_id"], F.col("sz")).select("doc_id", "size", "running_bytes")


def even_split(spark, d):
    out = chunking.even_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 7, ["o_orderkey"])
    return out.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def round_robin(spark, d):
    p = sort.with_position(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])
    return p.select(chunking.round_robin(F.col("pos"), 3).alias("worker"), "s_suppkey")


def systematic_sample(spark, d):
    return chunking.systematic_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 15)


def dup_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_ranges(spark, d):
    bucket = F.floor(F.col("o_custkey") / 100).cast("bigint")
    return table(spark, d, "orders").groupBy(bucket.alias("key_range")).agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))


def io_bound(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.avg(F.octet_length("text") + 12).alias("a"), F.var_pop(F.octet_length("text") + 12).alias("v"))
    return g.select("lang", chunking.io_bound(F.col("a"), F.col("v")).alias("io_bound"))


_LOG = [("a", 1, "starting"), ("a", 2, "[X] File=data/a.bin Threads=4 Memory=512 Time=3.25"), ("b", 1, "Time=9.5 early"), ("b", 2, "failed")]


def _times(spark):
    return spark.createDataFrame(timings.farm, "file string, units int, memory int, time double")


def _sequential(spark):
    return spark.createDataFrame(timings.sequential, "file string, time double")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def speedup_join(spark, d):
    out = analytics.speedup(_times(spark), _sequential(spark), "file", "time", "units")
    return out.select("file", "units", "speedup", "efficiency", analytics.dataset_name(F.col("file")).alias("dataset"))


def first_value_baseline(spark, d):
    out = analytics.baseline_first(_times(spark), "file", ["units"], "time")
    return out.select("file", "units", "base", F.round(F.col("base") / F.col("time"), 3).alias("speedup"))


def log_regex(spark, d):
    logs = spark.createDataFrame(_LOG, "run string, line_no int, line string")
    last = analytics.last_line(logs, ["run"])
    return last.select("run", analytics.logged_time(F.col("line")).alias("time"))


def sweep_grid(spark, d):
    g = analytics.sweep(spark, procs=[1, 2, 4, 8], threads=[16, 8, 4, 1])
    return g.withColumn("cores", analytics.total_cores(F.col("procs"), F.col("threads")))


def mean_per_cores(spark, d):
    g = spark.createDataFrame(timings.grid, "procs int, threads int, t double")
    out = analytics.mean_per(g.withColumn("cores", analytics.total_cores(F.col("procs"), F.col("threads"))), ["cores"], "t")
    return out.select("cores", F.round("mean_time", 6).alias("mean_time"))


def paired_lists(spark, d):
    files = sorted({r[0] for r in timings.farm})
    return analytics.pair_lists(spark, file=files, memory=[512, 2048, 1024])


def dataset_names(spark, d):
    name = lambda df: df.select(analytics.dataset_name(F.col("file")).alias("dataset"), "time")
    both = [name(_times(spark)), name(_sequential(spark))]
    timed = analytics.has_dataset(both[0], both[1].select("dataset").distinct(), "dataset").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return analytics.dataset_union(both, "dataset").join(timed, "dataset", "left")


def one_dataset(spark, d):
    """Distinct datasets, and for each the rows of it alone."""
    t = _times(spark).select(analytics.dataset_name(F.col("file")).alias("dataset"), "units", "time")
    names = analytics.datasets(t, "dataset")
    return merge.union_bag([analytics.of_dataset(t, "dataset", n).agg(F.min("time").alias("best"), F.min_by("units", F.struct("time", "units")).alias("units")).select(F.lit(n).alias("dataset"), "best", "units") for n in names])


def results_csv(spark, d):
    """Results appended to a CSV in two writes, and read back."""
    path = shared_dir(spark, "csv")
    analytics.append_results(_times(spark).filter("units <= 8"), path)
    analytics.append_results(_times(spark).filter("units > 8"), path)
    return analytics.read_results(spark, path, "file string, units int, memory int, time double")


def table_print(spark, d):
    return analytics.show_table(_times(spark).select("file", "units", F.col("time").alias("seconds")), ["seconds"])


def phase_times(spark, d):
    """Wall times of the phases of a sort: one row a phase, and whether they add up."""
    clock = analytics.Phases()
    path = shared_dir(spark, "runs")
    with clock.phase("runs"):
        runs = sort.store_runs(sort.local_runs(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 4, ["o_custkey"], ["o_orderkey"]), path)
    with clock.phase("merge"):
        n = merge.merge_runs(runs, ["o_custkey"], ["o_orderkey"]).count()
    rows = [(p, n, s > 0 and s <= clock.total) for p, s in clock.seconds.items()]
    return spark.createDataFrame(rows, "phase string, n bigint, timed boolean")


def output_names(spark, d):
    from tidemark.cli import output_name

    return spark.createDataFrame([(f, output_name(f)) for f in sorted({r[0] for r in timings.farm})], "file string, output string")


def rank_in_group(spark, d):
    df = table(spark, d, "lineitem").select(*LINEITEM)
    out = sort.position_in_group(df, "l_returnflag", ["l_shipdate"], name="rn")
    return out.select("l_returnflag", "rn", "l_orderkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (sort_full, sort_events_dupkeys, sort_desc_multi, topk, runs_by_key, merge_runs, union_bag, compare_bag, compare_ordered, verify_sorted, record_projection, filter_domain, record_size, size_stats, running_bytes, even_split, round_robin, systematic_sample, dup_keys, key_ranges, io_bound, speedup_join, first_value_baseline, log_regex, sweep_grid, mean_per_cores, paired_lists, dataset_names, one_dataset, results_csv, table_print, phase_times, output_names, rank_in_group)} | queries_records.QUERIES

_ORDER_ALL = f"SELECT {_LI}, row_number() OVER (ORDER BY {', '.join(c + ' NULLS FIRST' for c in LINEITEM)}) AS pos FROM lineitem"
_SIZES = "SELECT doc_id, CAST(strlen(text) + 12 AS BIGINT) AS size FROM documents"
_RUNNING = f"SELECT doc_id, size, CAST(sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM ({_SIZES})"
_EVENTS = "SELECT user_id, event_id, event_type, row_number() OVER (ORDER BY user_id, event_id{}) AS pos FROM events"
_GRID = "(VALUES (1),(2),(4),(8)) a(procs), (VALUES (16),(8),(4),(1)) b(threads)"

_FARM = f"(SELECT file, units, memory, CAST(time AS DOUBLE) AS time FROM (VALUES {_values(timings.farm)}) v(file, units, memory, time)) t"
_SEQ = f"(SELECT file, CAST(time AS DOUBLE) AS time FROM (VALUES {_values(timings.sequential)}) v(file, time)) s"
_NAME = "nullif(regexp_extract(file, 'data/(.*)\\.bin', 1), '')"

ORACLE = queries_records.ORACLE | {
    "sort_full": _ORDER_ALL,
    "merge_runs": _ORDER_ALL,
    "sort_events_dupkeys": _EVENTS.format(""),
    "sort_desc_multi": "SELECT o_totalprice, o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey, o_custkey) AS pos FROM orders",
    "topk": "SELECT o_totalprice, o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "runs_by_key": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 8 AS run_id, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey, o_custkey, o_totalprice) AS rank FROM orders",
    "union_bag": "WITH o AS (SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders) SELECT * FROM o UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem UNION ALL SELECT * FROM o",
    "compare_bag": """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders), m AS (SELECT * FROM o WHERE o_orderpriority <> '1-URGENT')
        SELECT 'same' AS case_name, (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM o)) AS only_a, (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM o)) AS only_b
        UNION ALL SELECT 'mutated', (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM m)), (SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM o))""",
    "compare_ordered": f"""WITH a AS ({_EVENTS.format("")}), b AS ({_EVENTS.format(" DESC")})
        SELECT 'flipped' AS case_name, count(*) AS mismatches FROM a FULL JOIN b USING (pos) WHERE (a.user_id, a.event_id, a.event_type) IS DISTINCT FROM (b.user_id, b.event_id, b.event_type)
        UNION ALL SELECT 'same', count(*) FROM a JOIN a AS c USING (pos) WHERE a.event_id <> c.event_id""",
    "verify_sorted": """WITH s AS (SELECT user_id, lag(user_id) OVER (ORDER BY user_id, event_id) AS p FROM events), r AS (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events)
        SELECT 'sorted' AS case_name, count(*) AS n, count(*) FILTER (WHERE p > user_id) AS inversions FROM s UNION ALL SELECT 'by_event', count(*), count(*) FILTER (WHERE p > user_id) FROM r""",
    "record_projection": "SELECT user_id AS key, count(*) AS n, CAST(sum(coalesce(strlen(props), 0)) AS BIGINT) AS bytes, CAST(CAST(user_id AS HUGEINT) - 9223372036854775808 AS BIGINT) AS sort_key FROM events GROUP BY user_id",
    "filter_domain": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS len FROM documents WHERE strlen(text) BETWEEN 8 AND 1024",
    "record_size": "SELECT doc_id, CAST(strlen(text) + 12 AS BIGINT) AS total_size FROM documents",
    "size_stats": f"""WITH s AS ({_SIZES}), a AS (SELECT CAST(sum(size) // count(*) AS BIGINT) AS m FROM s)
        SELECT count(*) AS n, any_value(m) AS avg_size, min(size) AS min_size, max(size) AS max_size, round(avg((size - m) * (size - m)), 3) AS size_variance FROM s, a""",
    "running_bytes": _RUNNING,
    "even_split": "SELECT chunk_id, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey, o_custkey) AS chunk_id FROM orders) GROUP BY chunk_id",
    "round_robin": "SELECT 1 + (row_number() OVER (ORDER BY s_suppkey) - 1) % 3 AS worker, s_suppkey FROM supplier",
    "systematic_sample": "SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) AS pos FROM orders) WHERE (pos - 1) % 15 = 0",
    "dup_keys": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "key_ranges": "SELECT o_custkey // 100 AS key_range, count(*) AS n, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1",
    "io_bound": "SELECT lang, (avg(strlen(text) + 12) > 512 OR var_pop(strlen(text) + 12) > avg(strlen(text) + 12) * 0.5) AS io_bound FROM documents GROUP BY lang",
    "speedup_join": f"""SELECT t.file AS file, units, round(s.time / t.time, 3) AS speedup, round(s.time / t.time / units, 3) AS efficiency, nullif(regexp_extract(t.file, 'data/(.*)\\.bin', 1), '') AS dataset
        FROM {_FARM} LEFT JOIN {_SEQ} ON t.file = s.file""",
    "first_value_baseline": f"SELECT file, units, base, round(base / time, 3) AS speedup FROM (SELECT *, first_value(time) OVER (PARTITION BY file ORDER BY units) AS base FROM {_FARM})",
    "log_regex": f"SELECT run, TRY_CAST(nullif(regexp_extract(arg_max(line, line_no), 'Time=([0-9.]+)', 1), '') AS DOUBLE) AS time FROM (VALUES {_values(_LOG)}) t(run, line_no, line) GROUP BY run",
    "sweep_grid": f"SELECT procs, threads, procs * threads AS cores FROM {_GRID}",
    "mean_per_cores": f"SELECT procs * threads AS cores, round(avg(t), 6) AS mean_time FROM (VALUES {_values(timings.grid)}) g(procs, threads, t_) , LATERAL (SELECT CAST(t_ AS DOUBLE) AS t) GROUP BY 1",
    "paired_lists": f"SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', {m})" for i, (f, m) in enumerate(zip(sorted({r[0] for r in timings.farm}), (512, 2048, 1024, 'NULL'))))}) t(i, file, memory)",
    "dataset_names": f"SELECT u.dataset AS dataset, n FROM (SELECT {_NAME} AS dataset FROM {_FARM} UNION SELECT {_NAME} FROM {_SEQ}) u LEFT JOIN (SELECT {_NAME} AS dataset, count(*) AS n FROM {_FARM} WHERE {_NAME} IN (SELECT {_NAME} FROM {_SEQ}) GROUP BY 1) k USING (dataset)",
    "one_dataset": f"SELECT {_NAME} AS dataset, min(time) AS best, arg_min(units, time) AS units FROM {_FARM} GROUP BY 1",
    "results_csv": f"SELECT file, units, memory, time FROM {_FARM}",
    "table_print": f"SELECT file, units, format('{{:,.2f}}', time) AS seconds FROM {_FARM}",
    "phase_times": "SELECT phase, n, true AS timed FROM (SELECT count(*) AS n FROM orders), (VALUES ('runs'), ('merge')) p(phase)",
    "output_names": f"SELECT DISTINCT file, regexp_replace(file, '\\.bin$', '_sorted_output.bin') AS output FROM {_FARM}",
    "rank_in_group": f"SELECT l_returnflag, rn, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, {', '.join(c for c in LINEITEM if c not in ('l_shipdate', 'l_returnflag'))}) AS rn FROM lineitem)",
}
