"""op7: quality scores and decisions for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import table
from tidemark.llm.quality import scored


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, labels=table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("quality", 6).alias("quality"), F.round("toxicity", 6).alias("toxicity"), "keep")


QUERIES = {"op7_quality": op7_quality}
