"""Global, local and positional sorts. Every sort has a total order: keys first, then a tie-breaker."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import ensure_checkpoint_dir, fresh, shared_dir

_UNSORTABLE = (T.MapType, T.VariantType)


def order_columns(df: DataFrame, keys: Sequence[str], tie: Sequence[str] | None = None) -> list[str]:
    """The keys, then ``tie``, or all remaining columns that can be ordered."""
    if tie is None:
        tie = [f.name for f in df.schema.fields if not isinstance(f.dataType, _UNSORTABLE)]
    return [*keys, *(c for c in tie if c not in keys)]


def _orders(columns: Sequence[str], descending: Sequence[str]) -> list[Column]:
    q = lambda c: F.col(f"`{c}`")
    return [q(c).desc_nulls_last() if c in descending else q(c).asc_nulls_first() for c in columns]


def global_sort(df: DataFrame, keys: Sequence[str], tie: Sequence[str] | None = None, descending: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """External sort: one range exchange and a spilling sort in each partition.

    The tie-breaker is part of the range key, so a key that holds a third of all rows is still dealt to many
    partitions. ``partitions`` fixes their number; else the session's setting and adaptive execution decide.
    """
    order = _orders(order_columns(df, keys, tie), descending)
    if partitions:
        return df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return df.orderBy(*order)


def local_runs(df: DataFrame, runs: int, keys: Sequence[str], tie: Sequence[str] | None = None) -> DataFrame:
    """Sorted runs: rows dealt evenly to ``runs`` partitions, each sorted; no order between runs. Adds ``run_id``."""
    order = _orders(order_columns(df, keys, tie), ())
    return df.repartition(runs).sortWithinPartitions(*order).withColumn("run_id", F.spark_partition_id())


def store_runs(runs: DataFrame, path: str) -> list[DataFrame]:
    """Write the runs of :func:`local_runs` below a folder, one subfolder each, and return them as they are read back."""
    runs.write.partitionBy("run_id").parquet(path)
    spark = runs.sparkSession
    fields = T.StructType([f for f in runs.schema.fields if f.name != "run_id"])
    ids = sorted(r[0] for r in spark.read.parquet(path).select("run_id").distinct().collect())
    return [spark.read.schema(fields).parquet(f"{path}/run_id={i}") for i in ids]


def _storable(df: DataFrame) -> bool:
    """Can the rows be written as Parquet?"""
    bad = (T.NullType, T.CalendarIntervalType, T.VariantType)

    def ok(t: T.DataType) -> bool:
        inner = [f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else [t.keyType, t.valueType] if isinstance(t, T.MapType) else []
        return not isinstance(t, bad) and all(map(ok, inner))

    names = [c.lower() for c in df.columns]
    return len(set(names)) == len(names) and ok(df.schema)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from the shared folder, as Parquet: compressed, read by columns, and free of lineage."""
    spark = df.sparkSession
    if not _storable(df):
        ensure_checkpoint_dir(spark)
        return df.checkpoint()
    folder = shared_dir(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _running(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running sums inside each partition, in its order: one pass over Arrow batches, no exchange."""
    at = {c: df.columns.index(c) for c in sums.values()}

    def run(batches):
        total = dict.fromkeys(sums, 0)
        for b in batches:
            if not b.num_rows:
                continue
            more = []
            for to, c in sums.items():
                x = pc.cumulative_sum(pc.fill_null(b.column(at[c]).cast(pa.int64()), 0), start=total[to])
                total[to] = x[-1].as_py()
                more.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *sums])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(to, T.LongType()) for to in sums)]))


def with_prefix(df: DataFrame, keys: Sequence[str], tie: Sequence[str] | None = None, descending: Sequence[str] = (), name: str = "pos", sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 1-based global position in sort order and running sums of long columns, without a single-partition window.

    Pass 1 sorts into range partitions, adds running sums inside each, and stores each row with its partition and place
    in it, as Parquet in the shared folder (so a lost executor costs nothing and both passes see the same partitions).
    Pass 2 adds to each place, and to each running sum, the totals of all earlier partitions: one row per partition,
    from a scan of those columns alone, goes to the driver and comes back as a broadcast of as many rows. So there is
    one exchange, whatever is asked for.

    ``sums`` maps the name of a running sum to its column.
    """
    spark = df.sparkSession
    sums = sums or {}
    part, at, *names = fresh(df, "__part", "__at", *(f"__base{i}" for i in range(1 + len(sums))))
    inside = dict(zip(fresh(df, *(f"__run{i}" for i in range(len(sums)))), sums.values(), strict=True))
    mid = F.monotonically_increasing_id()
    placed = global_sort(df, keys, tie, descending).withColumn(part, F.shiftright(mid, 33)).withColumn(at, mid.bitwiseAND((1 << 33) - 1))
    placed = stored(_running(placed, inside) if inside else placed, "ordered")
    whole = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"s{i}") for i, c in enumerate(sums.values())]
    bases, run = [], [0] * (1 + len(sums))
    for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *whole).orderBy(part).collect():
        bases.append((r[0], *run))
        run = [x + y for x, y in zip(run, r[1:], strict=True)]
    base = spark.createDataFrame(bases, ", ".join(f"`{n}` bigint" for n in (part, *names)))
    out = placed.join(F.broadcast(base), part).withColumn(name, F.col(at) + F.col(names[0]) + 1)
    for to, own, before in zip(sums, inside, names[1:], strict=True):
        out = out.withColumn(to, F.col(own) + F.col(before))
    return out.drop(part, at, *names, *inside)


def with_position(df: DataFrame, keys: Sequence[str], tie: Sequence[str] | None = None, descending: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Add the 1-based global position in sort order (see :func:`with_prefix`)."""
    return with_prefix(df, keys, tie, descending, name)


def position_in_group(df: DataFrame, group: str, keys: Sequence[str], tie: Sequence[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based position inside each group, for any sizes of groups: the position in the sort by (group, keys), less the
    positions of earlier groups. A group that holds most rows is spread like any others; group starts are joined back."""
    pos, first, same = fresh(df, "__pos", "__first", "__group")
    placed = with_position(df, [group, *keys], tie, name=pos)
    starts = placed.groupBy(F.col(f"`{group}`").alias(same)).agg(F.min(pos).alias(first))
    out = placed.join(starts, F.col(f"`{group}`").eqNullSafe(F.col(same)))
    return out.withColumn(name, F.col(pos) - F.col(first) + 1).drop(pos, first, same)


def runs_by_key(df: DataFrame, key: str, runs: int, tie: Sequence[str]) -> DataFrame:
    """Deterministic runs: ``run_id`` = key mod ``runs``, ``rank`` inside the run."""
    out = df.withColumn("run_id", F.pmod(F.col(key), F.lit(runs)).cast("bigint"))
    return position_in_group(out, "run_id", [key, *tie], [])


def top_k(df: DataFrame, k: int, keys: Sequence[str], tie: Sequence[str] | None = None, descending: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows in order: ``TakeOrderedAndProject``, k rows a task at most. (An extension of the sort.)"""
    return df.orderBy(*_orders(order_columns(df, keys, tie), descending)).limit(k)
