"""Repeatable randomness from md5, which other engines have too."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key(seed: int | str, *columns: str) -> Column:
    """A hash of the columns' text, as hex digits: an order that looks random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def uniform(seed: int | str, *columns: str) -> Column:
    """A number in [0, 1) from the hash's first 32 bits."""
    return F.conv(F.substring(key(seed, *columns), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
