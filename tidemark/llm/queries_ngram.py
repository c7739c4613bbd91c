"""op8: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.batches import table
from tidemark.llm.ngram import score


def op8_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram": op8_ngram}
