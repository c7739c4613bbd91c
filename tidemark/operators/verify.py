"""Checks of order and equality that can fail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sort import with_position
from tidemark.shared import fresh


@dataclass
class Order:
    ok: bool
    rows: int
    inversions: int
    first_bad: int | None  # 1-based position of the first row that is smaller than the one before


def _less(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """a < b and a = b. Nulls stand first, NaN last; both are equal to themselves, as in Spark's sort."""
    flags = lambda x: x.to_numpy(zero_copy_only=False)
    lt = flags(pc.fill_null(pc.less(a, b), False))
    eq = flags(pc.fill_null(pc.equal(a, b), False))
    if pa.types.is_floating(a.type):
        xa, xb = (flags(pc.fill_null(pc.is_nan(x), False)) for x in (a, b))
        lt, eq = np.where(xa | xb, ~xa & xb, lt), np.where(xa | xb, xa & xb, eq)
    na, nb = flags(pc.is_null(a)), flags(pc.is_null(b))
    return np.where(na | nb, na & ~nb, lt), np.where(na | nb, na & nb, eq)


def _descents(cols_a: list[pa.Array], cols_b: list[pa.Array]) -> np.ndarray:
    """Where row b stands before row a in key order."""
    bad, same = np.zeros(len(cols_a[0]), bool), np.ones(len(cols_a[0]), bool)
    for a, b in zip(cols_a, cols_b, strict=True):
        lt, eq = _less(b, a)
        bad |= same & lt
        same &= eq
    return bad


def partition_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per non-empty partition: rows, descents inside, first of them, and the first and last key.

    Nothing is shuffled; the rows are consumed as they come, so a sort below is not optimised away.
    """
    picked = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    key_type = T.StructType([T.StructField(f.name, f.dataType) for f in picked.schema.fields])
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "n", "bad", "first_bad")] + [T.StructField("lo", key_type), T.StructField("hi", key_type)])

    def scan(batches):
        from pyspark import TaskContext

        n = bad = 0
        first_bad = lo = hi = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [pa.concat_arrays([h, c]) if hi is not None else c for h, c in zip(hi or batch.columns, batch.columns, strict=True)]
            at = _descents([c[:-1] for c in cols], [c[1:] for c in cols])
            if at.any() and first_bad is None:
                first_bad = n + int(np.argmax(at)) + (1 if hi is None else 0)
            bad += int(at.sum())
            lo = lo or [c[:1] for c in batch.columns]
            hi = [c[-1:] for c in batch.columns]
            n += batch.num_rows
        if n:
            fields = [pa.field(f"k{i}", c.type) for i, c in enumerate(lo)]
            ends = [pa.StructArray.from_arrays(x, fields=fields) for x in (lo, hi)]
            longs = [pa.array([v], pa.int64()) for v in (TaskContext.get().partitionId(), n, bad, first_bad)]
            yield pa.RecordBatch.from_arrays([*longs, *ends], names=["part", "n", "bad", "first_bad", "lo", "hi"])

    return picked.mapInArrow(scan, schema)


def verify_sorted(df: DataFrame, keys: Sequence[str], expected_rows: int | None = None) -> Order:
    """Is the DataFrame, read in partition order, sorted by ``keys`` (ascending, nulls first)?

    One summary row a partition reaches the driver, where the borders between partitions are checked. With
    ``expected_rows`` lost or added rows fail too.
    """
    rows = sorted(partition_summary(df, keys).collect(), key=lambda r: r["part"])
    before = bad = 0
    first = hi = None
    flat = lambda s: [(0 if v is None else 2 if v != v else 1, v) for v in s]
    for r in rows:
        lo = flat(r["lo"])
        if hi is not None and _tuple_less(lo, hi):
            bad += 1
            first = before if first is None else first
        if r["bad"] and first is None:
            first = before + r["first_bad"]
        bad += r["bad"]
        before += r["n"]
        hi = flat(r["hi"])
    ok = bad == 0 and (expected_rows is None or expected_rows == before)
    return Order(ok, before, bad, None if first is None else first + 1)


def _tuple_less(a, b) -> bool:
    """Order of keys whose parts are (0, null), (1, value) or (2, NaN)."""
    for (ka, va), (kb, vb) in zip(a, b, strict=True):
        if ka != kb:
            return ka < kb
        if ka == 1 and va != vb:
            return va < vb
    return False


def verify_records(spark, path: str, **options) -> Order:
    """Order of a record file, or of a folder's files in their order. Malformed bytes fail instead of ending the scan."""
    from tidemark.sources.kvbin import read_records

    return verify_sorted(read_records(spark, path, ["sort_key"], **options), ["sort_key"])


def verify_ints(spark, path: str, **options) -> Order:
    from tidemark.sources.ints import read_ints

    return verify_sorted(read_ints(spark, path, **options), ["value"])


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with ``surplus`` (``surplus_`` if there is such a column) = count in a less count
    in b: one exchange, partial counts."""
    weight, surplus = fresh(a, "__w", "surplus")
    cols = [f"`{c}`" for c in a.columns]
    both = a.select(*cols, F.lit(1).alias(weight)).unionAll(b.select(*cols, F.lit(-1).alias(weight)))
    return both.groupBy(*cols).agg(F.sum(weight).cast("bigint").alias(surplus)).filter(F.col(surplus) != 0)


def equal_bag(a: DataFrame, b: DataFrame) -> bool:
    """Same rows with the same multiplicities, in any order."""
    return a.columns == b.columns and bag_difference(a, b).isEmpty()


def ordered_mismatches(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """Positions at which the two relations differ or only one has a row: pos, and both rows as structs l and r."""
    others = [f"`{c}`" for c in a.columns if c != pos]
    left = a.select(pos, F.struct(*others).alias("l"))
    right = b.select(pos, F.struct(*others).alias("r"))
    joined = left.join(right, pos, "full_outer")
    return joined.filter(~F.col("l").eqNullSafe(F.col("r")))


def equal_ordered(a: DataFrame, b: DataFrame, keys: Sequence[str], tie: Sequence[str] | None = None) -> bool:
    """Equal position by position after the same total sort."""
    return ordered_mismatches(with_position(a, keys, tie), with_position(b, keys, tie)).isEmpty()


def compare_files(spark, a: str, b: str) -> bool:
    """Positional comparison of two record files, payloads included."""
    from tidemark.sources.kvbin import read_records

    # File and offset are the order; the position follows from them.
    frames = [with_position(read_records(spark, p).select("file_id", "offset", "sort_key", "len", "payload"), ["file_id", "offset"], []).drop("file_id", "offset") for p in (a, b)]
    return ordered_mismatches(*frames).isEmpty()
