"""Repeatable row hashes: the same row gets the same number in every run and partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def row_hash(key: Column, seed: int | str = 42) -> Column:
    """A number in ``[0, 2**32)`` from the first 8 hex digits of md5(seed|key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def below(hash_value: Column, fraction: Column | float) -> Column:
    """True for about ``fraction`` of all hashes."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return hash_value < share * F.lit(float(HASH_RANGE))
