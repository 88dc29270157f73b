"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Nothing is collected: a round is two min-aggregations and two joins, and the only value the driver reads is a
checksum. Stars of any size are fine: aggregations combine before the shuffle, and the joins have one row per
key on one side, written before the join, so adaptive execution splits a hot key's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from genoquery.checkpoints import checkpoint

MAX_ROUNDS = 60
SMALL_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = checkpoint(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
    joined = near.join(low, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    pointed = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pointed.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of all edges of a partition, by union and find."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"], batch["v"], strict=True):
            a, b = sorted((find(u), find(v)))
            root[b] = a
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = 0) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node of its component.

    With `small`, a graph that has been counted to have no more edges than that is settled by one task instead of by rounds; the result is
    the same.
    Null ends and self-loops are skipped (a node with nothing but a self-loop is its own component). Ids may be of any
    type with an order. Row order, repeated and reversed edges make no difference.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    loops = clean.filter("u = v").select(F.col("u").alias("node"))
    now, seen = checkpoint(clean.filter("u <> v").distinct()), None
    if small and now.count() <= small:
        kind = dict(now.dtypes)["u"]
        found = checkpoint(
            now.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}")
        ) if not now.isEmpty() else now.toDF("node", "component")
        alone = loops.distinct().join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
        return found.unionByName(alone)
    for _ in range(MAX_ROUNDS):
        now = checkpoint(_star(_star(now, True), False))
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == seen:
            break
        seen = (row["n"], row["s"])
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    found = members.unionByName(roots)
    alone = loops.distinct().join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(alone)
