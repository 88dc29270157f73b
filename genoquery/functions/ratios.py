"""Ratios that are null where the denominator is not positive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(n: Column | str, d: Column | str) -> Column:
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return F.when(d > 0, n.cast("double") / F.nullif(d, F.lit(0)).cast("double"))


def tally(condition: Column | str) -> Column:
    """Rows for which the condition holds; null counts as no."""
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition).cast("bigint")
