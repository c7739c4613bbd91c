"""Merging of sorted runs, bag union, and ordered output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from tidemark.operators.sort import global_sort


def union_bag(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; duplicates stay."""
    if not frames:
        raise ValueError("no runs to unite")
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_runs(frames: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Merge runs into one ordered relation.

    The runs are united and range-partitioned, so the merge runs in parallel over disjoint key ranges; inside a
    partition Spark's sorter merges what it spilled.
    """
    return global_sort(union_bag(frames), keys, tie, partitions=partitions)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], tie: Sequence[str] | None = None, fmt: str = "parquet", single_file: bool = False, mode: str = "overwrite", **options) -> None:
    """Write sorted; part files in name order are globally sorted. ``single_file`` trades the parallel tail for one file."""
    out = global_sort(df, keys, tie)
    if single_file:
        out = out.coalesce(1)
    if fmt == "kvbin":
        from tidemark.sources.kvbin import write_records

        write_records(out, path, mode, **options)
    else:
        out.write.mode(mode).options(**options).format(fmt).save(path)
