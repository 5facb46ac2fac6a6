"""Reproducible buckets and ids: the same key always gives the same value.

A bucket number is taken from the first 32 bits of an md5 digest, so it does not
depend on the engine, the partitioning or the order of rows.
"""

from decimal import Decimal

from pyspark.sql import Column, functions as F


def _cols(keys):
    keys = keys if isinstance(keys, (list, tuple)) else [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def hash_bucket(keys, salt: str, n) -> Column:
    """Bucket in [0, n) of the key columns; never negative."""
    text = F.concat_ws("|", *[c.cast("string") for c in _cols(keys)], F.lit(salt))
    prefix = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return (prefix % n).cast("int")


def jitter(value: Column, keys, salt: str, percent: int) -> Column:
    """value moved by a whole percentage in [-percent, +percent)."""
    return value * (hash_bucket(keys, salt, 2 * percent) + (100 - percent)) * F.lit(Decimal("0.01"))


def format_id(prefix: str, number: Column, width: int) -> Column:
    """prefix plus the zero-padded number; longer numbers keep every digit."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))
