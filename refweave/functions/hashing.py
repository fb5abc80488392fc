"""The stable hash that names partitions, and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WRAP = (1 << 32) - 1


def partition_hash(key: Column) -> Column:
    """h = 31 h + byte over the UTF-8 bytes, wrapped to a signed 32-bit number (as a long)."""
    digits = F.hex(F.encode(key, "UTF-8"))
    pairs = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))  # once, so that the whole is linear in the key's length
    h = F.aggregate(pairs, F.lit(0).cast("long"), lambda h, x: (h * 31 + F.conv(x, 16, 10).cast("long")).bitwiseAND(F.lit(_WRAP)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def bucket(key: Column, parts: int) -> Column:
    return F.pmod(partition_hash(key), F.lit(parts).cast("long"))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)
