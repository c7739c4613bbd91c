"""Queries over the record format, generators, planners and the command line, each with the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import merge, sort, verify
from tidemark.plans import chunking
from tidemark.schema import HEADER_BYTES, as_records, record_bytes
from tidemark.shared import exists, scratch, shared_dir
from tidemark.sources import gen, ints, kvbin
from tidemark.sources.parts import data_files, delete_path, file_bytes, filesystem, path_exists
from tidemark.streaming.runs import finish, stream_runs

KIB = 1 << 10


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PAYLOAD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def _line_records(spark, d) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", *_PAYLOAD).alias("p"))
    return as_records(df, "l_orderkey", "p")


def kv_round_trip(spark, d):
    """Two writes (the second appends), a scan in small splits, the sort by key: every record with its place."""
    path = shared_dir(spark, "kv")
    r = _line_records(spark, d)
    small = F.pmod("key", F.lit(3)) == 0
    kvbin.write_records(r.filter(small), path)
    kvbin.write_records(r.filter(~small), path, mode="append")
    back = kvbin.read_records(spark, path, ["sort_key", "key", "len", "payload"], splitBytes=64 * KIB)
    out = sort.with_position(back, ["sort_key"], ["payload"])
    return out.select("pos", F.col("key").cast("bigint").alias("key"), F.col("len").cast("bigint").alias("len"), F.col("payload").cast("string").alias("payload"))


def kv_splits(spark, d):
    """One file cut by a walk in tasks, by its side files, and by arithmetic: the same records each time."""
    r = _line_records(spark, d).select("sort_key", "payload").coalesce(1)
    fixed = r.withColumn("payload", F.rpad(F.col("payload").cast("string"), 64, "#").cast("binary"))
    foreign, same = shared_dir(spark, "kv"), shared_dir(spark, "kv")
    kvbin.write_records(r, foreign, sideFiles="false")
    kvbin.write_records(fixed, same, sideFiles="false")
    rules = {"splitBytes": 64 * KIB}
    walked = kvbin.read_records(spark, foreign, ["key", "len"], **rules)
    parts = [("walk", walked), ("arithmetic", kvbin.read_records(spark, same, ["key", "len"], fixedLen=64, **rules))]
    walked = walked.rdd.getNumPartitions()
    kvbin.index_files(spark, foreign, **rules)
    parts.append(("side file", kvbin.read_records(spark, foreign, ["key", "len"], **rules)))
    out = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("key").cast("bigint").alias("keys"), F.sum("len").alias("bytes")).select(F.lit(how).alias("how"), "*", F.lit(df.rdd.getNumPartitions() > 1).alias("cut")) for how, df in parts]
    return merge.union_bag(out)


def kv_modes(spark, d):
    """A file in which some payloads are too short: what each mode makes of it."""
    path = shared_dir(spark, "kv")
    r = as_records(table(spark, d, "orders").orderBy("o_orderkey"), "o_orderkey", "o_orderpriority")
    kvbin.write_records(r.coalesce(1), path, minLen=1)
    read = lambda **o: kvbin.read_records(spark, path, ["key", "len", "corrupt"], **o)
    cases = [("loose", read(minLen=1)), ("prefix", read(mode="PREFIX")), ("permissive", read(mode="PERMISSIVE"))]
    return merge.union_bag([df.agg(F.count("key").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"), F.count("corrupt").alias("corrupt")).select(F.lit(m).alias("mode"), "*") for m, df in cases])


def kv_key_range(spark, d):
    """Keys and lengths alone, in a range of keys: payloads are skipped in the scan."""
    path = shared_dir(spark, "kv")
    kvbin.write_records(_line_records(spark, d), path)
    low = -(1 << 63)
    return kvbin.read_records(spark, path, ["key", "len"], minKey=low + 100, maxKey=low + 5000).select(F.col("key").cast("bigint").alias("key"), F.col("len").cast("bigint").alias("len"))


def file_facts(spark, d):
    """Bytes on disk, existence, deletion, and what is left of temporary folders."""
    path = shared_dir(spark, "kv")
    kvbin.write_records(_line_records(spark, d), path)
    facts = [("bytes", file_bytes(path)), ("there", int(path_exists(path))), ("deleted", int(delete_path(path))), ("there after", int(path_exists(path))), ("deleted again", int(delete_path(path)))]
    with scratch(spark):
        temp = shared_dir(spark, "kv")
        kvbin.write_records(_line_records(spark, d), temp)
        facts.append(("scratch", int(exists(spark, temp))))
    facts.append(("scratch after", int(exists(spark, temp))))
    return spark.createDataFrame(facts, "fact string, value bigint")


def ordered_file(spark, d):
    """One ordered file, written twice over; its order and bytes."""
    path = shared_dir(spark, "kv")
    r = _line_records(spark, d)
    for _ in range(2):
        merge.write_ordered(r, path, ["sort_key"], ["payload"], fmt="kvbin", single_file=True)
    fs, root = filesystem(path)
    order = verify.verify_records(spark, path)
    rows = [(len(data_files(fs, root)), order.rows, order.inversions, file_bytes(path))]
    return spark.createDataFrame(rows, "files bigint, n bigint, inversions bigint, bytes bigint")


def compare_files(spark, d):
    """Positional comparison of record files: the same, one payload changed, one record less."""
    r = _line_records(spark, d).select("sort_key", "payload")
    changed = r.withColumn("payload", F.when(F.col("payload").startswith(F.lit(b"1|1|")), F.lit(b"something else")).otherwise(F.col("payload")))
    paths = [shared_dir(spark, "kv") for _ in range(4)]
    for df, path in zip((r, r, changed, r.filter(~F.col("payload").startswith(F.lit(b"1|1|")))), paths, strict=True):
        merge.write_ordered(df, path, ["sort_key"], ["payload"], fmt="kvbin")
    rows = [(case, verify.compare_files(spark, paths[0], p)) for case, p in zip(("same", "changed", "shorter"), paths[1:], strict=True)]
    return spark.createDataFrame(rows, "case_name string, equal boolean")


def int_order(spark, d):
    """Flat integer files, sorted and not."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = []
    for case, df in (("sorted", sort.global_sort(o, ["o_custkey"])), ("by_order", sort.global_sort(o, ["o_orderkey"]))):
        path = shared_dir(spark, "ints")
        ints.write_ints(df, path, "o_custkey")
        got = verify.verify_ints(spark, path, splitBytes=8 * KIB)
        total = ints.read_ints(spark, path).agg(F.sum("value")).first()[0]
        rows.append((case, got.rows, got.inversions, total))
    return spark.createDataFrame(rows, "case_name string, n bigint, inversions bigint, total bigint")


def verify_floats(spark, d):
    """Order of doubles with NaN, which stands last, and nulls, which stand first."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(7)) == 0, float("nan")).when(F.pmod("o_orderkey", F.lit(11)) != 0, F.col("o_totalprice")).alias("x"))
    rows = []
    for case, df in (("sorted", sort.global_sort(o, ["x"])), ("by_order", sort.global_sort(o, ["o_orderkey"]))):
        got = verify.verify_sorted(df, ["x"])
        rows.append((case, got.rows, got.inversions))
    return spark.createDataFrame(rows, "case_name string, n bigint, inversions bigint")


def local_runs(spark, d):
    """Eight sorted runs: rows, descents inside them, and whether they are of about one size."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    runs = sort.local_runs(o, 8, ["o_custkey"], ["o_orderkey"])
    s = verify.partition_summary(runs, ["o_custkey", "o_orderkey"])
    even = F.max("n") - F.min("n") <= F.lit(o.rdd.getNumPartitions())
    return s.agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"), F.sum("bad").alias("descents"), even.alias("even"))


def stream_merge(spark, d):
    """Micro-batches become sorted runs, which are merged once the stream has ended."""
    src, runs, ck = (shared_dir(spark, x) for x in ("stream", "runs", "stream-ck"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o.repartition(4, "o_orderkey").write.parquet(src)
    s = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_runs(s, runs, ["o_custkey"], ["o_orderkey"], ck).awaitTermination()
    return sort.with_position(finish(spark, runs, ["o_custkey"], ["o_orderkey"]), ["o_custkey"], ["o_orderkey"])


def generators(spark, d):
    """What each generator promises, measured on its records."""
    cases = [("count", gen.gen_count(spark, 3000, 64)), ("size", gen.gen_size(spark, 100_000, 100)), ("fixed", gen.gen_mode(spark, 1000, "FIXED")), ("max", gen.gen_mode(spark, 200, "MAX")), ("random", gen.gen_mode(spark, 3000, "RANDOM"))]
    out = []
    for how, df in cases:
        letters = "^[A-Z]*$" if how in ("count", "size") else "^[0-9A-Za-z]*$"
        low, high = (0, (1 << 31) - 1) if how in ("count", "size") else (1, 10**9)
        ok = F.col("payload").cast("string").rlike(letters) & F.col("key").between(low, high) & (F.octet_length("payload") == F.col("len")) & F.col("len").between(8, 1024)
        fixed = F.when(F.min("len") == F.max("len"), F.min("len")).otherwise(0)
        out.append(df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("legal"), fixed.cast("bigint").alias("fixed_len"), (F.count_distinct("key") > F.count(F.lit(1)) * 0.99).alias("spread"), (F.sum(record_bytes(F.col("payload"))) >= 100_000).alias("reached")).select(F.lit(how).alias("how"), "*"))
    return merge.union_bag(out)


SIZES = (760_000_000, 5_240_000_000, 3_800_000_000, 26_200_000_000)
THREADS = (1, 4, 8, 16)
MEMORY = (512 << 20, 10240 << 20)


def chunk_rules(spark, d):
    """All chunk-size rules over a grid of file sizes, threads and budgets."""
    rows = []
    for s in SIZES:
        for t in THREADS:
            for m in MEMORY:
                cfg = chunking.preset(t, m)
                chunk = chunking.adaptive_chunk(s, 76, cfg)
                even = chunking.even_count_chunk(s, chunk, cfg)
                rows.append((s, t, m, chunking.sequential_chunk(m), chunking.threaded_chunk(s, m, t), chunking.farm_chunk(s, m, t), chunking.distributed_chunk(s, m, t), chunking.clamped_chunk(m, t), cfg.min_chunk, cfg.safety, chunk, even, chunking.merge_fanout(chunking.ceil_div(s, even), m)))
    names = "size threads memory sequential threaded farm distributed clamped min_chunk safety adaptive even_count fanout".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'safety' else 'bigint'}" for n in names))


def _doc_sizes(spark, d) -> DataFrame:
    """Stored, so that the texts are read once, not for each pass over their sizes."""
    sizes = table(spark, d, "documents").select("doc_id", F.coalesce(record_bytes(F.col("text")), F.lit(HEADER_BYTES)).cast("bigint").alias("size"))
    return sort.stored(sizes, "sizes")


def pack_bytes(spark, d):
    """Greedy packing: a chunk is closed by the record with which it holds 64 KiB or more."""
    return chunking.greedy_chunks(_doc_sizes(spark, d), ["doc_id"], "size", 64 * KIB).select("doc_id", "size", "chunk_id")


def _chunk_rows(spark, chunks):
    return spark.createDataFrame([(i, c.start, c.length, c.records) for i, c in enumerate(chunks, 1)], "chunk_id bigint, start bigint, bytes bigint, records bigint")


def balance_chunks(spark, d):
    """Small chunks joined with their neighbours."""
    rows = chunking.greedy_chunks(_doc_sizes(spark, d), ["doc_id"], "size", 16 * KIB)
    return _chunk_rows(spark, chunking.balance(chunking.chunk_list(rows, "size")))


PLAN = chunking.Config(memory=256 * KIB, threads=4, min_chunk=16 * KIB, max_chunk=128 * KIB)


def plan_chunks(spark, d):
    """The whole plan: statistics, chunk size, chunks of whole records, balance."""
    plan = chunking.plan_chunks(_doc_sizes(spark, d), ["doc_id"], "size", PLAN)
    return _chunk_rows(spark, plan.chunks).withColumns({"chunk_bytes": F.lit(plan.chunk_bytes).cast("bigint"), "fanout": F.lit(plan.fanout).cast("bigint"), "io_bound": F.lit(plan.io_bound)})


def cli_commands(spark, d):
    """Exit codes of the command line, each command on real files."""
    from tidemark import cli

    f, out, more = (shared_dir(spark, "cli").removeprefix("file:") for _ in range(3))
    calls = [
        ("gen_count", ["gen_count", f, "2000", "32"]), ("gen count bad length", ["gen_count", f + "x", "5", "3"]), ("gen_size", ["gen_size", more, "1", "64"]), ("verify raw", ["verify", f]), ("sort", ["sort", f, "64", "2", "--output", out]),
        ("verify sorted", ["verify", out]), ("compare same", ["compare", out, out]), ("compare other", ["compare", f, out]), ("merge", ["merge", f + "-merged", out, out]), ("verify merged", ["verify", f + "-merged"]), ("benchmark", ["benchmark", f, "64", "2"]),
        ("plan", ["plan", f]), ("delete", ["delete", f]), ("delete again", ["delete", f]), ("verify missing", ["verify", f]),
    ]
    codes = []
    for name, args in calls:
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            codes.append((name, cli.main(args)))
    names = [("output name", int(cli.output_name("a/x.bin") != "a/x_sorted_output.bin"))]
    return spark.createDataFrame(codes + names, "command string, code bigint")


QUERIES = {f.__name__: f for f in (kv_round_trip, kv_splits, kv_modes, kv_key_range, file_facts, ordered_file, compare_files, int_order, verify_floats, local_runs, stream_merge, generators, chunk_rules, pack_bytes, balance_chunks, plan_chunks, cli_commands)}

_P = f"concat_ws('|', {', '.join(_PAYLOAD)})"
_GB = 1 << 30
_MIB = 1 << 20
_DOCS = f"SELECT doc_id, CAST(coalesce(strlen(text), 0) + {HEADER_BYTES} AS BIGINT) AS size, row_number() OVER (ORDER BY doc_id) AS i FROM documents"


def _greedy(target: str, source: str = _DOCS) -> str:
    """CTEs ``r``, ``g`` and ``c``: rows, their chunks, and the list of chunks."""
    return f"""r AS ({source}), g(i, open, chunk) AS (
            SELECT CAST(1 AS BIGINT), size, CAST(1 AS BIGINT) FROM r WHERE i = 1
            UNION ALL SELECT r.i, CASE WHEN open >= {target} THEN r.size ELSE open + r.size END, CASE WHEN open >= {target} THEN chunk + 1 ELSE chunk END FROM g JOIN r ON r.i = g.i + 1),
        l AS (SELECT chunk, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS records FROM g JOIN r USING (i) GROUP BY chunk),
        c AS (SELECT chunk, CAST(sum(bytes) OVER (ORDER BY chunk) - bytes AS BIGINT) AS start, bytes, records FROM l)"""


_BALANCE = """m AS (SELECT CAST(sum(bytes) AS BIGINT) // count(*) AS mean, count(*) AS n FROM c),
        u AS (SELECT n > 1 AND max(CASE WHEN bytes < 0.8 * mean OR bytes > 1.2 * mean THEN 1 ELSE 0 END) = 1 AS uneven FROM c, m GROUP BY n),
        k AS (SELECT c.*, lead(bytes) OVER (ORDER BY chunk) AS b2, lead(records) OVER (ORDER BY chunk) AS r2 FROM c),
        j AS (SELECT k.*, uneven AND b2 IS NOT NULL AND bytes < 0.8 * mean AND bytes + b2 <= 1.5 * mean AS two FROM k, m, u),
        w(chunk, two) AS (SELECT chunk, two FROM j WHERE chunk = 1 UNION ALL SELECT j.chunk, j.two FROM w JOIN j ON j.chunk = w.chunk + CASE WHEN w.two THEN 2 ELSE 1 END),
        b AS (SELECT row_number() OVER (ORDER BY j.chunk) AS chunk_id, start, bytes + CASE WHEN j.two THEN b2 ELSE 0 END AS bytes, records + CASE WHEN j.two THEN r2 ELSE 0 END AS records FROM w JOIN j USING (chunk))"""


def _adaptive(size: str, avg: str, threads: str, memory: str, safety: str, low: str, high: str) -> list[str]:
    """The adaptive chunk size, as successive expressions over a column ``room``."""
    return [
        f"CAST(floor(floor(floor({memory} * {safety}) / 2.5) / 1.3) AS BIGINT)",
        f"CASE WHEN {threads} > 1 THEN greatest(room // 4, room // greatest(1, {threads} // 2)) ELSE room END",
        f"CASE WHEN {size} < {memory} THEN greatest(room, {size} // 4) WHEN {size} > {100 * _GB} THEN greatest(room, {size} // 1000) ELSE room END",
        f"greatest({low}, least(room, {high}))",
        f"CASE WHEN least({threads}, {size} // {low}) > 0 THEN least(room, {size} // least({threads}, {size} // {low})) ELSE room END",
        f"CASE WHEN {avg} > 0 AND {size} // greatest(1, {avg}) > 1000 THEN greatest(room, {avg} * 1000) ELSE room END",
    ]


def _chain(source: str, steps: list[str], keep: str) -> str:
    out = f"SELECT *, {steps[0]} AS room FROM ({source})"
    for s in steps[1:]:
        out = f"SELECT {keep}, {s} AS room FROM ({out})"
    return out


_CEIL = "(({0} + {1} - 1) // {1})"
_EVEN = "CASE WHEN {n} % 2 = 0 THEN room ELSE greatest({low}, least({half}, {high})) END"
_FAN = "CASE WHEN {n} <= least({m} // 67108864, 256) THEN {n} ELSE least(greatest(CAST(floor(sqrt({n})) AS BIGINT), 8), least({m} // 67108864, 256)) END"
_GRID = f"""SELECT size, threads, memory, CASE WHEN threads = 1 THEN 128 WHEN threads <= 4 THEN 64 ELSE 32 END * CAST({_MIB} AS BIGINT) AS min_chunk, CAST(CASE WHEN threads = 1 THEN 0.9 WHEN threads <= 4 THEN 0.8 ELSE 0.7 END AS DOUBLE) AS safety
        FROM (VALUES {", ".join(f"(CAST({x} AS BIGINT))" for x in SIZES)}) a(size), (VALUES {", ".join(f"(CAST({x} AS BIGINT))" for x in THREADS)}) b(threads), (VALUES {", ".join(f"(CAST({x} AS BIGINT))" for x in MEMORY)}) c(memory)"""
_ADAPT = _chain(_GRID, _adaptive("size", "76", "threads", "memory", "safety", "min_chunk", str(2048 * _MIB)), "size, threads, memory, min_chunk, safety")
_RULES = f"""WITH a AS ({_ADAPT}), e AS (SELECT *, {_EVEN.format(n=_CEIL.format("size", "room"), low="min_chunk", high=2048 * _MIB, half=_CEIL.format("size", "(" + _CEIL.format("size", "room") + " + 1)"))} AS even_count,
            CAST(floor(memory * 0.8::DOUBLE) AS BIGINT) AS sequential, greatest(1, CAST(floor((memory // threads) * 0.8::DOUBLE) AS BIGINT)) AS share, size // greatest(1, threads - 1) AS even FROM a)
        SELECT size, threads, memory, sequential, size // greatest({_CEIL.format("size", "share")}, threads) AS threaded, size // greatest({_CEIL.format("size", "share")}, threads) AS farm,
            CASE WHEN even <= sequential THEN even ELSE {_CEIL.format("size", "(" + _CEIL.format("size", "sequential") + ")")} END AS distributed, greatest({16 * _MIB}, least(memory // threads, {_GB})) AS clamped,
            min_chunk, safety, room AS adaptive, even_count, {_FAN.format(n=_CEIL.format("size", "even_count"), m="memory")} AS fanout FROM e"""

_STATS = f"SELECT CAST(sum(size) AS BIGINT) AS total, CAST(sum(size) AS BIGINT) // count(*) AS avg FROM ({_DOCS})"
_BOUND = f"SELECT s.*, (avg > 512 OR (SELECT avg(CAST(size - s.avg AS DOUBLE) * (size - s.avg)) FROM ({_DOCS})) > avg * 0.5) AS io_bound FROM ({_STATS}) s"
_SIZED = _chain(_BOUND, _adaptive("total", "avg", "4", str(PLAN.memory), "0.8::DOUBLE", str(PLAN.min_chunk), str(PLAN.max_chunk)), "total, avg, io_bound")
_CUT = f"""SELECT io_bound, {_EVEN.format(n=_CEIL.format("total", "room"), low=PLAN.min_chunk, high=PLAN.max_chunk, half=_CEIL.format("total", "(" + _CEIL.format("total", "room") + " + 1)"))} AS chunk_bytes
        FROM (SELECT total, io_bound, CASE WHEN io_bound THEN least(CAST(floor(room * 1.5) AS BIGINT), {PLAN.max_chunk}) ELSE room END AS room FROM ({_SIZED}))"""

_LENS = "strlen(o_orderpriority)"
_FIRST = f"(SELECT min(o_orderkey) FROM orders WHERE {_LENS} < 8)"
_CODES = "gen_count:0 gen_count_bad_length:1 gen_size:0 verify_raw:1 sort:0 verify_sorted:0 compare_same:0 compare_other:1 merge:0 verify_merged:0 benchmark:0 plan:0 delete:0 delete_again:1 verify_missing:1 output_name:0"

ORACLE = {
    "kv_round_trip": f"SELECT row_number() OVER (ORDER BY l_orderkey, encode({_P})) AS pos, l_orderkey AS key, CAST(strlen({_P}) AS BIGINT) AS len, {_P} AS payload FROM lineitem",
    "kv_splits": f"""SELECT how, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(CASE WHEN how = 'arithmetic' THEN 64 ELSE strlen({_P}) END) AS BIGINT) AS bytes, true AS cut
        FROM lineitem, (VALUES ('walk'), ('arithmetic'), ('side file')) h(how) GROUP BY how""",
    "kv_modes": f"""SELECT 'loose' AS mode, count(*) AS n, CAST(sum({_LENS}) AS BIGINT) AS bytes, 0 AS corrupt FROM orders
        UNION ALL SELECT 'prefix', count(*), CAST(coalesce(sum({_LENS}), 0) AS BIGINT), 0 FROM orders WHERE o_orderkey < {_FIRST}
        UNION ALL SELECT 'permissive', count(*), CAST(coalesce(sum({_LENS}), 0) AS BIGINT), 1 FROM orders WHERE o_orderkey < {_FIRST}""",
    "kv_key_range": f"SELECT l_orderkey AS key, CAST(strlen({_P}) AS BIGINT) AS len FROM lineitem WHERE l_orderkey BETWEEN 100 AND 5000",
    "file_facts": f"""SELECT 'bytes' AS fact, CAST(sum(strlen({_P}) + {HEADER_BYTES}) AS BIGINT) AS value FROM lineitem
        UNION ALL SELECT * FROM (VALUES ('there', 1), ('deleted', 1), ('there after', 0), ('deleted again', 0), ('scratch', 1), ('scratch after', 0))""",
    "ordered_file": f"SELECT 1 AS files, count(*) AS n, 0 AS inversions, CAST(sum(strlen({_P}) + {HEADER_BYTES}) AS BIGINT) AS bytes FROM lineitem",
    "compare_files": f"SELECT * FROM (VALUES ('same', true), ('changed', (SELECT count(*) = 0 FROM lineitem WHERE {_P} LIKE '1|1|%')), ('shorter', (SELECT count(*) = 0 FROM lineitem WHERE {_P} LIKE '1|1|%'))) t(case_name, equal)",
    "int_order": """WITH s AS (SELECT o_custkey AS x, lag(o_custkey) OVER (ORDER BY o_custkey, o_orderkey) AS p FROM orders), r AS (SELECT o_custkey AS x, lag(o_custkey) OVER (ORDER BY o_orderkey, o_custkey) AS p FROM orders)
        SELECT 'sorted' AS case_name, count(*) AS n, count(*) FILTER (WHERE p > x) AS inversions, CAST(sum(x) AS BIGINT) AS total FROM s UNION ALL SELECT 'by_order', count(*), count(*) FILTER (WHERE p > x), CAST(sum(x) AS BIGINT) FROM r""",
    "verify_floats": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS x FROM orders),
            r AS (SELECT x, lag(x) OVER w AS p, row_number() OVER w > 1 AS later FROM o WINDOW w AS (ORDER BY o_orderkey))
        SELECT 'sorted' AS case_name, count(*) AS n, 0 AS inversions FROM o UNION ALL SELECT 'by_order', count(*), count(*) FILTER (WHERE later AND p IS NOT NULL AND (x IS NULL OR p > x)) FROM r""",
    "local_runs": "SELECT 8 AS runs, count(*) AS n, 0 AS descents, true AS even FROM orders",
    "stream_merge": "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders",
    "generators": f"""SELECT * FROM (VALUES ('count', 3000, 3000, 64, true, true), ('size', {-(-100_000 // 112)}, {-(-100_000 // 112)}, 100, true, true), ('fixed', 1000, 1000, 64, true, false), ('max', 200, 200, 1024, true, true), ('random', 3000, 3000, 0, true, true)) t(how, n, legal, fixed_len, spread, reached)""",
    "chunk_rules": _RULES,
    "pack_bytes": f"WITH RECURSIVE {_greedy(str(64 * KIB))} SELECT doc_id, size, chunk AS chunk_id FROM g JOIN r USING (i)",
    "balance_chunks": f"WITH RECURSIVE {_greedy(str(16 * KIB))}, {_BALANCE} SELECT * FROM b",
    "plan_chunks": f"""WITH RECURSIVE t AS ({_CUT}), {_greedy("(SELECT chunk_bytes FROM t)")}, {_BALANCE}, f AS (SELECT count(*) AS n FROM c)
        SELECT b.*, chunk_bytes, io_bound, {_FAN.format(n="n", m=PLAN.memory)} AS fanout FROM b, t, f""",
    "cli_commands": "SELECT * FROM (VALUES " + ", ".join(f"('{c.split(':')[0].replace('_', ' ') if c.split(':')[0] not in ('gen_count', 'gen_size') else c.split(':')[0]}', {c.split(':')[1]})" for c in _CODES.split()) + ") t(command, code)",
}
