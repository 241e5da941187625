"""Row hashes that other engines can reproduce, and their bucket prefixes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_DIGITS = 3  # 4,096 equal slices of the hash range


def row_hash(keys, seed: int | str = 42) -> Column:
    """``md5('seed|key1|key2...')`` as 32 hex digits; a null key reads as ''."""
    parts = [F.lit(str(seed))]
    parts += [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(hashed: Column, digits: int = 8, start: int = 1) -> Column:
    """Integer value of some hex digits of a row hash."""
    return F.conv(F.substring(hashed, start, digits), 16, 10).cast("bigint")


def hash_unit(hashed: Column, start: int = 1) -> Column:
    """Uniform value in [0, 1) from eight hex digits of a row hash."""
    return hash_int(hashed, 8, start).cast("double") / F.lit(float(16**8))
