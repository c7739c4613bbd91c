"""op6: all documents into token files in the shared folder, and read back from them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.batches import table
from tidemark.llm.tokenfile import crc32_of, read_token_files, token_folder, write_token_files


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = write_token_files(docs, token_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)

    return read_token_files(spark, shards, digest=crc32_of).withColumnRenamed("digest", "ids_crc32")


QUERIES = {"op6_token_files": op6_token_files}
