"""Benchmark analytics: sweeps, log parsing, speed-up and efficiency."""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sweep(spark: SparkSession, **axes: Sequence[int]) -> DataFrame:
    """Cross product of short parameter lists, one column each."""
    df = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in axes.items()])
    for k in axes:
        df = df.withColumn(k, F.explode(k))
    return df


def pair_lists(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """Two or more lists side by side, by index; shorter ones are filled with nulls."""
    df = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()])
    return df.select(F.posexplode(F.arrays_zip(*lists)).alias("i", "p")).select("i", "p.*")


def last_line(logs: DataFrame, group: Sequence[str], line: str = "line", number: str = "line_no") -> DataFrame:
    return logs.groupBy(*group).agg(F.max_by(line, number).alias(line))


def logged_time(line: Column) -> Column:
    """Seconds after ``Time=``; null if absent."""
    return F.regexp_extract(line, r"Time=([0-9.]+)", 1).try_cast("double")


def dataset_name(path: Column) -> Column:
    """``x`` of ``data/x.bin``; null if the path is of another form."""
    return F.nullif(F.regexp_extract(path, r"data/(.*)\.bin", 1), F.lit(""))


def speedup(results: DataFrame, sequential: DataFrame, on: str, time_col: str, units: str, digits: int = 3) -> DataFrame:
    """Sequential time over time, and that per unit; null where either time is missing. ``sequential`` has one row a file."""
    base = sequential.select(on, F.col(time_col).alias("seq_time"))
    out = results.join(base, on, "left")
    out = out.withColumn("speedup", F.col("seq_time") / F.col(time_col))
    return out.withColumn("efficiency", F.round(F.col("speedup") / F.col(units), digits)).withColumn("speedup", F.round("speedup", digits))


def baseline_first(results: DataFrame, group: str, order: Sequence[str], time_col: str) -> DataFrame:
    """The first time of each series, beside every row of it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return results.withColumn("base", F.first(time_col).over(w))


def total_cores(procs: Column, threads: Column) -> Column:
    return procs * threads


def mean_per(results: DataFrame, by: Sequence[str], time_col: str) -> DataFrame:
    """Mean over repeated points of a curve."""
    return results.groupBy(*by).agg(F.avg(time_col).alias("mean_time"))


def dataset_union(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """All dataset names that any frame has, sorted."""
    out = frames[0].select(column)
    for f in frames[1:]:
        out = out.union(f.select(column))
    return out.distinct().orderBy(column)


def datasets(frame: DataFrame, column: str) -> list:
    """The distinct dataset names of a result table (a few), sorted."""
    return [r[0] for r in frame.select(column).distinct().orderBy(column).collect()]


def of_dataset(frame: DataFrame, column: str, name) -> DataFrame:
    """Rows of one dataset."""
    return frame.filter(F.col(column).eqNullSafe(F.lit(name)))


def has_dataset(frame: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose dataset is in ``names``."""
    return frame.join(names, column, "left_semi")


def show_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers as text with two decimals."""
    return df.select(*[F.format_number(c, 2).alias(c) if c in columns else F.col(c) for c in df.columns])


def read_results(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A result CSV with its header; blanks are nulls."""
    return spark.read.csv(path, header=True, schema=ddl)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


class Phases:
    """Wall time of named phases."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        begin = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - begin

    @property
    def total(self) -> float:
        return sum(self.seconds.values())
