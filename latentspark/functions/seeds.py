"""Randomness by hash, so that a result doesn't depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def hash_number(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 from the parts joined by `|`."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number inside (0, 1)."""
    return (hash_number(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def permuted_rank(keys: list[str], of: str, *seed: Column | str) -> Column:
    """1, 2, ... within keys, in an order drawn by the seed and column `of`."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(hash_number(*seed, F.col(of).cast("string")), of))


def drawn_shift(n: Column, *seed: Column | str, least: int = 0) -> Column:
    """A shift from `least` to n - least - 1 (0 if there is none)."""
    room = n - F.lit(2 * least)
    return F.when(room > 0, F.pmod(hash_number(*seed), room) + least).otherwise(F.lit(0)).cast("long")
