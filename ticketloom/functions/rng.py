"""Random numbers that any engine with md5 reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def hash_u(key: Column, seed: str | int) -> Column:
    """A bigint in [0, 2**32) from the key's text and the seed."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")


def sql_hash_u(key: str, seed: str | int) -> str:
    """The same in SQL."""
    return f"('0x' || substr(md5(({key})::varchar || ':{seed}'), 1, 8))::bigint"
