"""Deterministic record generators: a row depends on its id and the seed only, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.unsigned import to_sort_key
from tidemark.schema import HEADER_BYTES, MAX_LEN, MIN_LEN

#: Fixed alphabets of the generated payloads.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _letters(length: Column, alphabet: str, seed: int) -> Column:
    pick = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), length), pick), "").cast("binary")


def _records(spark: SparkSession, n: int, key: Column, length: Column, alphabet: str, seed: int) -> DataFrame:
    df = spark.range(n).select("id", key.cast("decimal(20,0)").alias("key"), length.cast("int").alias("len"))
    df = df.withColumn("payload", _letters(F.col("len"), alphabet, seed))
    return df.select("id", "key", to_sort_key(F.col("key")).alias("sort_key"), "len", "payload")


def gen_count(spark: SparkSession, n: int, length: int = 100, seed: int = 1) -> DataFrame:
    """``n`` records, payloads of ``length`` capitals, keys in [0, 2^31)."""
    if not MIN_LEN <= length <= MAX_LEN:
        raise ValueError(f"payload length {length} is outside [{MIN_LEN}, {MAX_LEN}]")
    key = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("key")), F.lit(1 << 31))
    return _records(spark, n, key, F.lit(length), UPPER, seed)


def gen_size(spark: SparkSession, size: int, length: int = 100, seed: int = 1) -> DataFrame:
    """The fewest records that take ``size`` bytes or more."""
    return gen_count(spark, -(-size // (HEADER_BYTES + length)), length, seed)


def gen_mode(spark: SparkSession, n: int, mode: str = "FIXED", fixed_len: int = 64, seed: int = 1) -> DataFrame:
    """RANDOM: lengths uniform in [8, 1024]; FIXED: ``fixed_len``; MAX: 1024. Keys uniform in [1, 10^9]."""
    if mode == "RANDOM":
        length = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("len")), F.lit(MAX_LEN - MIN_LEN + 1)) + MIN_LEN
    elif mode in ("FIXED", "MAX"):
        n_bytes = fixed_len if mode == "FIXED" else MAX_LEN
        if not MIN_LEN <= n_bytes <= MAX_LEN:
            raise ValueError(f"payload length {n_bytes} is outside [{MIN_LEN}, {MAX_LEN}]")
        length = F.lit(n_bytes)
    else:
        raise ValueError(f"unknown mode {mode}")
    key = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("key")), F.lit(10**9)) + 1
    return _records(spark, n, key, length, ALNUM, seed)
