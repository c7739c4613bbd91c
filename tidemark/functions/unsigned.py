"""Unsigned 64-bit keys on Spark's signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^63 as text: the gateway takes no integers this large.
_HALF = "9223372036854775808"


def to_sort_key(key: Column) -> Column:
    """decimal(20,0) -> bigint in the same order: the key with its top bit flipped."""
    return (key - F.lit(_HALF).cast("decimal(20,0)")).cast("bigint")


def from_sort_key(sort_key: Column) -> Column:
    """bigint of :func:`to_sort_key` -> decimal(20,0)."""
    return (sort_key.cast("decimal(20,0)") + F.lit(_HALF).cast("decimal(20,0)")).cast("decimal(20,0)")


def reinterpret_signed(value: Column) -> Column:
    """A bigint that holds unsigned bits -> its sort key."""
    return value.bitwiseXOR(F.expr("-9223372036854775807L - 1L"))
