"""The record relation ``(key, len, payload)`` and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.unsigned import to_sort_key

# Fixed values of the file format.
HEADER_BYTES = 12
MIN_LEN = 8
MAX_LEN = 1024

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.DecimalType(20, 0), False),
        T.StructField("len", T.IntegerType(), False),
        T.StructField("payload", T.BinaryType(), False),
    ]
)


def in_domain(length: Column, low: int = MIN_LEN, high: int = MAX_LEN) -> Column:
    """True where a payload length is legal."""
    return length.between(low, high)


def record_bytes(payload: Column) -> Column:
    """Bytes that a record takes on disk."""
    return (F.octet_length(payload) + F.lit(HEADER_BYTES)).cast("long")


def as_records(df: DataFrame, key: Column | str, payload: Column | str) -> DataFrame:
    """View any table as records; ``key`` must hold integers of 0 or more, ``payload`` strings or bytes.

    Null payloads become empty ones, which ``in_domain`` then rejects; null keys stay null and sort first.
    """
    key = F.col(key) if isinstance(key, str) else key
    payload = F.col(payload) if isinstance(payload, str) else payload
    out = df.select(
        key.cast("decimal(20,0)").alias("key"),
        F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"),
    )
    return out.select(
        "key",
        to_sort_key(F.col("key")).alias("sort_key"),
        F.octet_length("payload").alias("len"),
        "payload",
    )


def validate(df: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Apply the length rule to a record DataFrame: FAILFAST raises, DROP skips, PERMISSIVE flags in ``valid``."""
    ok = in_domain(F.col("len")) & (F.col("len") == F.octet_length("payload"))
    if mode == "DROP":
        return df.filter(ok)
    if mode == "PERMISSIVE":
        return df.withColumn("valid", F.coalesce(ok, F.lit(False)))
    if mode != "FAILFAST":
        raise ValueError(f"unknown mode {mode}")
    bad = F.raise_error(F.concat(F.lit("illegal payload length "), F.col("len").cast("string")))
    return df.withColumn("len", F.when(ok, F.col("len")).otherwise(bad.cast("int")))
