"""op4: the 20 nearest of every twentieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import Settings, search
from tidemark.llm.batches import table


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, "vec_id", "embedding", Settings(k=20))


QUERIES = {"op4_ann": op4_ann}
