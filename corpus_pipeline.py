"""From raw documents to packed training sequences.

Stages, in order: the quality classifier rejects documents; near-dedup keeps one document of each group of near copies;
personal data and terms that disclose it are replaced; what is left is packed into sequences. Each stage takes
(spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of ``documents``.

Defined cases: documents of null or empty text are kept by the classifier, are one group for near-dedup, and are packed as
their end id alone; very long texts are worked on whole; of ties and repeated rows near-dedup keeps the row of the smallest
id, the first one read; null ids are kept as such; an empty table gives an empty result; further columns, also of names
used inside, come through unchanged (``n_chars`` follows the text where personal data is taken out).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import table
from tidemark.llm.jaccard import near_copies_removed
from tidemark.llm.packing import TRAINING, first_line, pack_documents
from tidemark.llm.pii import sanitised
from tidemark.llm.quality import quality_filter
from tidemark.shared import scratch, shared_dir

#: SQL can express neither the classifier nor the fingerprints; the tests hold the result against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality_filter(docs, labels=table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies_removed(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; ``n_chars`` follows the text."""
    out = sanitised(docs, distinct=True)  # near-dedup has left one of each group
    if "n_chars" not in docs.columns:
        return out
    kind = dict(docs.dtypes)["n_chars"]
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, 16 segments and 3968 tokens behind the first line."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, limits=TRAINING, prompt_of=first_line)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage has stored for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
