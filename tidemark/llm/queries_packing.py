"""op5: all documents packed into sequences of at most 4096 tokens, 16 segments and 3968 loss-bearing tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.batches import table
from tidemark.llm.packing import TRAINING, first_line, pack_documents


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, limits=TRAINING, prompt_of=first_line)


QUERIES = {"op5_packing": op5_packing}
