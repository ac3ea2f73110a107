"""Word sets as sorted arrays of 64-bit hashes, made in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words in order, repeats included; null text has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def hashed(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def digest(array: Column) -> tuple[Column, Column]:
    """128 bits that stand for an array of 64-bit hashes."""
    return F.xxhash64(array), F.xxhash64(F.lit(0x5BD1E995), array)
