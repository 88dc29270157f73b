"""Running sums and minima over a whole table in order, without a task that sees all of it.

Rows are dealt to partitions by range, summed up within each, and each partition starts from the totals of those before it: the only
unpartitioned window runs over one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from genoquery.checkpoints import checkpoint


def running(
    df: DataFrame, by: str, sums: dict[str, Column], minima: dict[str, Column] | None = None, following: str | None = None,
    descending: bool = False
) -> DataFrame:
    """df with inclusive running sums and minima in order of `by`, whose values are distinct and not null; `following` names a column for
    the next row's `by`."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    minima = minima or {}
    parts = {**{n: (F.sum, c) for n, c in sums.items()}, **{n: (F.min, c) for n, c in minima.items()}}
    terms = df.select("*", *(c.alias(f"__t_{n}") for n, (_, c) in parts.items()))
    # written once, so that a row's partition is the same whoever reads it
    dealt = checkpoint(terms.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), wide=True)
    first = (F.max if descending else F.min)(by).alias("__first")
    totals = dealt.groupBy("__part").agg(first, *(f(f"__t_{n}").alias(f"__b_{n}") for n, (f, _) in parts.items()))
    along = Window.orderBy("__part")  # a row per partition
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(
        "__part", F.lead("__first").over(along).alias("__ahead"),
        *(f(f"__b_{n}").over(before).alias(f"__b_{n}") for n, (f, _) in parts.items())
    )
    own = Window.partitionBy("__part").orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = dealt.join(F.broadcast(ahead), "__part")  # as many rows as partitions
    made = []
    for n, (f, _) in parts.items():
        here, base = f(f"__t_{n}").over(upto), F.col(f"__b_{n}")
        made.append((here + F.coalesce(base, F.lit(0)) if f is F.sum else F.least(here, base)).alias(n))
    if following:
        made.append(F.coalesce(F.lead(by).over(own), F.col("__ahead")).alias(following))
    return both.select(*df.columns, *made)
