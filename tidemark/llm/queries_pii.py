"""op9: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import table
from tidemark.llm.pii import KINDS, find_personal


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, one), ",")
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[number(k) for k in KINDS],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "secret_spans", "term_spans")).alias("spans"),
        F.size("secret_spans").cast("bigint").alias("n_secret"),
        F.size("term_spans").cast("bigint").alias("n_term"),
        (F.size("base_spans") + F.size("secret_spans") + F.size("term_spans")).cast("bigint").alias("n_spans"),
    )


QUERIES = {"op9_pii": op9_pii}
