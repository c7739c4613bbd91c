"""Split planning: record-size statistics in Spark, chunk-size rules and chunk lists in plain Python.

Spark places its own splits; these planners answer "how would N workers with M bytes cut this input" and feed
``splitBytes`` of the record source. The driver works on statistics and on one number per chunk or partition, never on
the rows; chunks are made of whole records.
"""

from __future__ import annotations

import bisect
import math
import uuid
from array import array
from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sort import global_sort, stored, with_position, with_prefix
from tidemark.shared import fresh, shared_dir
from tidemark.sources.parts import filesystem

MIB = 1 << 20
GIB = 1 << 30


@dataclass(frozen=True)
class Config:
    """Planner settings; the numbers are the fixed defaults of the planning rules."""

    memory: int = 32 * GIB
    threads: int = 8
    min_chunk: int = 64 * MIB
    max_chunk: int = 2048 * MIB
    safety: float = 0.8
    sort_overhead: float = 2.5
    record_overhead: float = 1.3
    balance: bool = True


def preset(threads: int, memory: int | None = None, base: Config = Config()) -> Config:
    """Settings by degree of parallelism."""
    min_mib, safety = (128, 0.9) if threads == 1 else (64, 0.8) if threads <= 4 else (32, 0.7)
    return replace(base, threads=threads, memory=memory or base.memory, min_chunk=min_mib * MIB, safety=safety)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


def sequential_chunk(budget: int) -> int:
    return int(budget * 0.8)


def threaded_chunk(size: int, budget: int, threads: int) -> int:
    """At least one chunk a thread, none over 80 % of a thread's share."""
    share = max(1, int((budget // threads) * 0.8))
    return size // max(ceil_div(size, share), threads)


#: The task farm plans as threads do.
farm_chunk = threaded_chunk


def distributed_chunk(size: int, budget: int, ranks: int) -> int:
    """One chunk a worker if that fits, else the fewest even chunks that do."""
    safe = int(budget * 0.8)
    even = size // max(1, ranks - 1)
    return even if even <= safe else ceil_div(size, ceil_div(size, safe))


def clamped_chunk(memory: int, threads: int, margin: float = 1.0) -> int:
    return clamp(int(memory * margin) // max(1, threads), 16 * MIB, GIB)


def adaptive_chunk(size: int, avg_record: int, cfg: Config) -> int:
    """Memory less sorting and record overhead, shared between threads, then fitted to file, limits and record size."""
    room = int(int(int(cfg.memory * cfg.safety) / cfg.sort_overhead) / cfg.record_overhead)
    if cfg.threads > 1:
        room = max(room // 4, room // max(1, cfg.threads // 2))
    if size < cfg.memory:
        room = max(room, size // 4)
    elif size > 100 * GIB:
        room = max(room, size // 1000)
    room = clamp(room, cfg.min_chunk, cfg.max_chunk)
    at_least = min(cfg.threads, size // cfg.min_chunk)
    if at_least:
        room = min(room, size // at_least)
    if avg_record and size // avg_record > 1000:
        room = max(room, avg_record * 1000)
    return room


def io_bound(avg: Column | float, variance: Column | float):
    """Large or uneven records."""
    return (avg > 512) | (variance > avg * 0.5)


def even_count_chunk(size: int, chunk: int, cfg: Config) -> int:
    """Shrink the chunk so that their number is even."""
    n = ceil_div(size, chunk)
    return chunk if n % 2 == 0 else clamp(ceil_div(size, n + 1), cfg.min_chunk, cfg.max_chunk)


def merge_fanout(runs: int, memory: int) -> int:
    """All runs at once if memory has 64 MiB for each and they are 256 at most; else about their square root."""
    most = min(memory // (64 * MIB), 256)
    return runs if runs <= most else min(max(math.isqrt(runs), 8), most)


@dataclass(frozen=True)
class Chunk:
    start: int
    length: int
    records: int


def pack_bytes(sizes: Iterable[int], target: int) -> list[Chunk]:
    """Greedy: a chunk is closed once it holds ``target`` bytes or more."""
    out: list[Chunk] = []
    start = length = records = 0
    for s in sizes:
        length += s
        records += 1
        if length >= target:
            out.append(Chunk(start, length, records))
            start, length, records = start + length, 0, 0
    if records:
        out.append(Chunk(start, length, records))
    return out


class _Longs:
    """Longs of a file, read one at a time."""

    def __init__(self, stream, first: int, n: int):
        self.f, self.first, self.n = stream, first, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        self.f.seek(8 * (self.first + i))
        return int.from_bytes(self.f.read(8), "little")


def _steps(cum: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row that can be the first to close a chunk in its partition (one within the first ``target`` bytes): the
    bytes left open at the partition's end, and how many chunks are closed in it."""
    n = int(np.searchsorted(cum, target)) + 1
    at = np.arange(min(n, len(cum)))
    last, count = at.copy(), np.ones(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        # Paths that have met stay together, so each row is looked up once.
        own, back = np.unique(last[live], return_inverse=True)
        after = np.searchsorted(cum, cum[own] + target)[back]
        on = after < len(cum)
        live = live[on]
        last[live] = after[on]
        count[live] += 1
    return cum[-1] - cum[last], count


def greedy_chunks(df: DataFrame, keys: Sequence[str], size: str, target: int, tie: Sequence[str] | None = None, name: str = "chunk_id") -> DataFrame:
    """:func:`pack_bytes` over the rows in sort order: adds the 1-based chunk of each row.

    Where a chunk closes depends on all rows before, but of these only on the bytes left open. So each sorted partition
    writes its running bytes and, for every row that can be the first to close a chunk in it, what is then left open at
    its end; the driver walks over partitions (a binary search in each one's file), and each partition then writes its
    own closing rows, in which each row looks up its chunk. Rows are shuffled once, by the sort, and the closing rows of
    a partition never stand in a row.
    """
    spark = df.sparkSession
    part, at, file = fresh(df, "__part", "__at", "__file")
    folder = shared_dir(spark, "chunks")
    column = df.columns.index(size)
    mid = F.monotonically_increasing_id()
    placed = global_sort(df, keys, tie).withColumn(part, F.shiftright(mid, 33)).withColumn(at, mid.bitwiseAND((1 << 33) - 1))

    def running(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        own, total, out = uuid.uuid4().hex, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or fs.open_output_stream(f"{root}/{own}")
            cum = total + np.cumsum(b.column(column).cast(pa.int64()).fill_null(0).to_numpy())
            total = int(cum[-1])
            out.write(cum.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.repeat(pa.scalar(own), b.num_rows)], names=[*b.schema.names, file])
        if out is not None:
            out.close()

    placed = stored(placed.mapInArrow(running, T.StructType([*placed.schema.fields, T.StructField(file, T.StringType())])), "ordered")
    parts = placed.groupBy(part, file).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect()
    if not parts:
        return placed.withColumn(name, F.lit(None).cast("bigint")).drop(part, at, file)

    def steps(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for own in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{own}") as f:
                    cum = np.frombuffer(f.read(), "<i8")
                left, count = _steps(cum, target)
                to = f"{own}.{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{root}/{to}") as f:
                    f.write(np.concatenate([cum[: len(left)], left, count]).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([to]), pa.array([len(left)], pa.int64()), pa.array([int(cum[-1])], pa.int64())], names=["file", "steps", "m", "bytes"])

    def closing(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for own, open_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_stream(f"{root}/{own}") as f:
                    cum = np.frombuffer(f.read(), "<i8")
                rows, need = array("q"), target - open_
                while (i := int(np.searchsorted(cum, need))) < len(cum):
                    rows.append(i)
                    need = int(cum[i]) + target
                to = f"{own}.{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{root}/{to}") as f:
                    f.write(np.array(rows, "<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([to])], names=["file", "ends"])

    def numbered(batches):
        fs, root = filesystem(folder)
        held, ends, before = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            place = b.column(file_at).dictionary_encode()
            code, rows, chunk = place.indices.to_numpy(), b.column(row_at).to_numpy(), np.empty(b.num_rows, np.int64)
            for i, own in enumerate(place.dictionary.to_pylist()):
                if own != held:
                    held, (before, to) = own, ends_of[own]
                    with fs.open_input_stream(f"{root}/{to}") as f:
                        ends = np.frombuffer(f.read(), "<i8")
                mine = code == i
                chunk[mine] = before + 1 + np.searchsorted(ends, rows[mine])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(chunk)], names=names)

    one_each = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(len(parts))
    found = {r["file"]: r for r in one_each([(r[file],) for r in parts], "file string").mapInArrow(steps, "file string, steps string, m bigint, bytes bigint").collect()}
    fs, root = filesystem(folder)
    open_, closed, states, earlier = 0, 0, [], {}
    for r in parts:
        states.append((r[file], open_))
        earlier[r[file]] = closed
        own = found[r[file]]
        if open_ + own["bytes"] < target:
            open_ += own["bytes"]
            continue
        with fs.open_input_file(f"{root}/{own['steps']}") as f:
            m = own["m"]
            i = bisect.bisect_left(_Longs(f, 0, m), target - open_)
            open_ = _Longs(f, m, m)[i]
            closed += _Longs(f, 2 * m, m)[i]
    to = one_each(states, "file string, open bigint").mapInArrow(closing, "file string, ends string").collect()
    ends_of = {r["file"]: (earlier[r["file"]], r["ends"]) for r in to}
    kept, names = range(len(df.columns)), [*df.columns, name]
    row_at, file_at = placed.columns.index(at), placed.columns.index(file)
    return placed.mapInArrow(numbered, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def chunk_list(rows: DataFrame, size: str, name: str = "chunk_id") -> list[Chunk]:
    """The chunks of :func:`greedy_chunks`, one row each to the driver."""
    out, start = [], 0
    for r in rows.groupBy(name).agg(F.sum(size).cast("bigint").alias("b"), F.count(F.lit(1)).alias("n")).orderBy(name).collect():
        out.append(Chunk(start, r["b"], r["n"]))
        start += r["b"]
    return out


def balance(chunks: Sequence[Chunk]) -> list[Chunk]:
    """If a chunk is over 20 % off the mean, join each small one with its neighbour where the two stay below 1.5 means."""
    if len(chunks) < 2:
        return list(chunks)
    mean = sum(c.length for c in chunks) // len(chunks)
    if all(0.8 * mean <= c.length <= 1.2 * mean for c in chunks):
        return list(chunks)
    out: list[Chunk] = []
    rest = deque(chunks)
    while rest:
        head = rest.popleft()
        if rest and head.length < 0.8 * mean and head.length + rest[0].length <= 1.5 * mean:
            tail = rest.popleft()
            head = Chunk(head.start, head.length + tail.length, head.records + tail.records)
        out.append(head)
    return out


def size_stats(sizes: DataFrame, column: str = "size") -> DataFrame:
    """n, truncated mean, min, max, and mean squared deviation from the truncated mean, in one aggregation.

    The deviation is expanded into sums (exact decimals), so no second pass and no broadcast mean is needed.
    """
    x = F.col(column).cast("decimal(20,0)")
    s = sizes.agg(F.count(column).alias("n"), F.sum(x).alias("s1"), F.sum((x * x).cast("decimal(38,0)")).alias("s2"), F.min(column).cast("bigint").alias("min_size"), F.max(column).cast("bigint").alias("max_size"))
    avg = F.expr("cast(s1 as decimal(38,0)) div n").cast("bigint")
    s = s.withColumn("avg_size", avg)
    # Exact up to the one division: sum((x - m)^2) = s2 - 2 m s1 + n m m.
    whole = F.expr("cast(s2 as decimal(38,0)) - cast(2 * cast(avg_size as decimal(19,0)) as decimal(19,0)) * cast(s1 as decimal(19,0)) + cast(n as decimal(19,0)) * cast(cast(avg_size as decimal(19,0)) * cast(avg_size as decimal(19,0)) as decimal(38,0))")
    return s.select("n", "avg_size", "min_size", "max_size", (whole.cast("double") / F.col("n")).alias("size_variance"))


def systematic_sample(df: DataFrame, keys: Sequence[str], every: int, tie: Sequence[str] | None = None) -> DataFrame:
    """Every ``every``-th row in sort order, from the first."""
    return with_position(df, keys, tie).filter((F.col("pos") - 1) % every == 0)


def even_split(df: DataFrame, chunks: int, keys: Sequence[str], tie: Sequence[str] | None = None) -> DataFrame:
    """NTILE without a single-partition window: the first ``n % chunks`` chunks get one row more."""
    placed = with_position(df, keys, tie)
    n = placed.count()
    q, r = divmod(n, chunks)
    p = F.col("pos") - 1
    if q == 0:
        return placed.withColumn("chunk_id", (p + 1).cast("bigint"))
    chunk = F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor((p - r * (q + 1)) / q)) + 1
    return placed.withColumn("chunk_id", chunk.cast("bigint"))


def running_bytes(df: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """Cumulative bytes in key order, as partition sums plus a running sum inside each partition."""
    return with_prefix(df.withColumn("size", size.cast("bigint")), keys, sums={"running_bytes": "size"})


def round_robin(pos: Column, workers: int) -> Column:
    """Worker of the chunk at 1-based ``pos``: 1, 2, ..., workers, 1, ..."""
    return (F.lit(1) + F.pmod(pos - 1, F.lit(workers))).cast("bigint")


@dataclass(frozen=True)
class Plan:
    chunk_bytes: int
    chunks: list[Chunk]
    fanout: int
    io_bound: bool


def plan_size(total: int, stats, cfg: Config) -> tuple[int, bool]:
    """Chunk size and I/O-boundness from total bytes and the row of :func:`size_stats`."""
    avg = max(1, int(stats["avg_size"] or 1))
    chunk = adaptive_chunk(total, avg, cfg)
    bound = bool(io_bound(avg, float(stats["size_variance"] or 0)))
    if bound:
        chunk = min(int(chunk * 1.5), cfg.max_chunk)
    return even_count_chunk(total, max(1, chunk), cfg), bound


def plan_chunks(df: DataFrame, keys: Sequence[str], size: str, cfg: Config, tie: Sequence[str] | None = None) -> Plan:
    """Statistics -> chunk size -> chunks of whole records, in order of ``keys`` -> balance.

    ``size`` is the column of record sizes. Starts and record counts are exact; rows stay where they are, only one row a
    chunk comes to the driver.
    """
    df = df.withColumn(size, F.col(size).cast("bigint"))
    stats = size_stats(df, size).first()
    total = df.agg(F.sum(size)).first()[0] or 0
    if not total:
        return Plan(0, [], 0, False)
    chunk, bound = plan_size(total, stats, cfg)
    chunks = chunk_list(greedy_chunks(df, keys, size, chunk, tie), size)
    return Plan(chunk, balance(chunks) if cfg.balance else chunks, merge_fanout(len(chunks), cfg.memory), bound)
