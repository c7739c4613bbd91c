"""Sorted runs from a stream of records: the task farm's counterpart in Structured Streaming.

Each micro-batch becomes one range-partitioned, sorted run below ``path``; rewriting a run by its batch id makes a
replayed batch harmless. ``finish`` merges all runs once the stream has ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.merge import merge_runs
from tidemark.operators.sort import global_sort


def stream_runs(stream: DataFrame, path: str, keys: Sequence[str], tie: Sequence[str] | None, checkpoint: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        global_sort(batch, keys, tie).write.mode("overwrite").parquet(f"{path}/run={batch_id:08d}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, path: str, keys: Sequence[str], tie: Sequence[str] | None = None) -> DataFrame:
    return merge_runs([spark.read.parquet(path).drop("run")], keys, tie)
