"""Single-linkage clusters of similar accessions, their quality and their order.

Distances are rows (id1, md1, id2, md2, d), in either direction and possibly repeated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.functions.ratios import ratio, tally
from genoquery.operators.components import SMALL_EDGES, connected_components

THRESHOLD, PRUNE, NEAR = 0.035, 0.2, 1.2


def load_pairs(rows: DataFrame, max_d: float = 1.0) -> DataFrame:
    """The smallest distance of each unordered pair (a < b), up to max_d."""
    return rows.filter((F.col("d") <= max_d) & (F.col("id1") != F.col("id2"))).select(
        F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "d"
    ).groupBy("a", "b").agg(F.min("d").alias("d"))


def missing_counts(rows: DataFrame) -> DataFrame:
    """Missing dosages of each id that a distance names."""
    return rows.select(F.col("id1").alias("id"), F.col("md1").alias("md")).unionByName(
        rows.select(F.col("id2").alias("id"), F.col("md2").alias("md"))
    ).groupBy("id").agg(F.min("md").alias("md"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def link(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """An edge is a pair at most the threshold apart."""
    return pairs.filter(F.col("d") <= threshold)


def components(edges: DataFrame) -> DataFrame:
    """C4: (id, cluster); a cluster is named by its smallest id."""
    return connected_components(edges, "a", "b", SMALL_EDGES).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def prune(edges: DataFrame, factor: float = PRUNE) -> DataFrame:
    """Edges without vertices whose degree is below factor * (size of their cluster - 1), by degrees and sizes before any is removed."""
    degree = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    parts = components(edges)
    size = parts.groupBy("cluster").agg(F.count("*").alias("size"))
    weak = parts.join(size, "cluster").join(degree, "id").filter(F.col("degree") < factor * (F.col("size") - 1)).select("id")
    return edges.join(
        weak.withColumnRenamed("id", "a"), "a", "left_anti"
    ).join(weak.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "d")


def members(pairs: DataFrame, md: DataFrame, threshold: float = THRESHOLD, factor: float = PRUNE) -> DataFrame:
    """Cluster, id, degree, rms_d, rank (1 is the representative: fewest missing, then highest degree, then id)."""
    edges = checkpoint(prune(link(pairs, threshold), factor))
    parts = checkpoint(components(edges))
    degree = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    size = parts.groupBy("cluster").agg(F.count("*").alias("size"))
    inside = _inside(pairs, parts)
    square = both_ways(inside).groupBy(F.col("a").alias("id")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    rows = parts.join(size, "cluster").join(degree, "id").join(md, "id", "left").join(square, "id", "left")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("md", F.desc("degree"), "id"))
    return rows.select(
        "cluster", "id", "degree", "md", F.round(F.sqrt(F.coalesce("dd", F.lit(0.0)) / (F.col("size") - 1)), 9).alias("rms_d"),
        rank.alias("rank")
    )


def _inside(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Known distances within clusters: cluster, a, b, d."""
    one, two = parts.select(F.col("id").alias("a"), "cluster"), parts.select(F.col("id").alias("b"), F.col("cluster").alias("other"))
    return pairs.join(one, "a").join(two, "b").filter("cluster = other").select("cluster", "a", "b", "d")


def cluster_table(
    pairs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, near: float = NEAR, min_ratio: float = -1.0
) -> DataFrame:
    """A row per cluster: size, min_d, avg_d, max_d, gap (100 if there's no other), n_near, n_pts_near, n_far, n_unknown,
    min_degree, ids by rank.

    n_far counts inner pairs beyond the threshold, n_unknown those without a distance. Near means below near * threshold, strictly.
    """
    inside = _inside(pairs, found.select("id", "cluster")).groupBy("cluster").agg(
        F.min("d").alias("min_d"), F.avg("d").alias("avg_d"), F.max("d").alias("max_d"),
        F.count_if(F.col("d") > threshold).alias("n_far"), F.count("*").alias("n_known")
    )
    own = found.select(F.col("id").alias("a"), "cluster")
    beyond = both_ways(pairs).join(own, "a").join(
        found.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b", "left"
    ).filter("other is null or other <> cluster")
    close = F.col("d") < near * threshold
    outside = beyond.groupBy("cluster").agg(
        F.min("d").alias("gap"), F.count_distinct(F.when(close, F.col("b"))).alias("n_near"),
        F.count_distinct(F.when(close, F.col("a"))).alias("n_pts_near")
    )
    shape = found.groupBy("cluster").agg(
        F.count("*").alias("size"), F.min("degree").alias("min_degree"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids")
    )
    rows = shape.join(inside, "cluster").join(outside, "cluster", "left")
    gap = F.coalesce("gap", F.lit(100.0))
    rows = rows.filter((F.col("max_d") == 0) | (gap / F.nullif("max_d", F.lit(0.0)) >= min_ratio))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "cluster", "size", "min_d", F.round("avg_d", 9).alias("avg_d"), "max_d", gap.alias("gap"), zero("n_near"), zero("n_pts_near"),
        "n_far", (F.expr("size * (size - 1) div 2") - F.col("n_known")).alias("n_unknown"), "min_degree",
        F.array_join("ids", ",").alias("ids")
    )


def ordered(table: DataFrame) -> DataFrame:
    """By size, average and largest distance, then falling gap, then first id."""
    return table.orderBy("size", "avg_d", "max_d", F.desc("gap"), "ids")


def consensus(genotypes: DataFrame, found: DataFrame, share: float = 2 / 3) -> DataFrame:
    """C11: per cluster and marker the dosage that at least `share` of the members have, else null; and each member's distance to it comes
    from `consensus_distance`."""
    counted = genotypes.join(found.select(F.col("id").alias("acc_id"), "cluster"), "acc_id").groupBy("cluster", "marker").agg(
        F.count("*").alias("n"), *(tally(f"dosage = {d}").alias(f"n{d}") for d in (0, 1, 2))
    )
    pick = F.when(
        F.col("n0") >= share * F.col("n"), 0
    ).when(F.col("n1") >= share * F.col("n"), 1).when(F.col("n2") >= share * F.col("n"), 2)
    return counted.select("cluster", "marker", pick.alias("dosage"))


def consensus_distance(genotypes: DataFrame, found: DataFrame, share: float = 2 / 3) -> DataFrame:
    """C11: agmr of each member and its cluster's consensus."""
    agreed = consensus(genotypes, found, share).withColumnRenamed("dosage", "c")
    rows = genotypes.join(
        found.select(F.col("id").alias("acc_id"), "cluster"), "acc_id"
    ).join(agreed, ["cluster", "marker"]).filter("dosage is not null and c is not null")
    return rows.groupBy("cluster", "acc_id").agg(
        tally("dosage <> c").alias("n"), F.count("*").alias("d")
    ).withColumn("agmr", ratio("n", "d"))


FOREST_EDGES = 200_000


def _kruskal(rows: pd.DataFrame) -> tuple[list[int], list[tuple[str, str, float]]]:
    """The edges (by place, rows come in order) that join two parts, and the merges: smaller name, larger name, height; a part is named by
    its smallest id."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept, merges = [], []
    for i, (x, y, d) in enumerate(zip(rows["a"], rows["b"], rows["d"], strict=True)):
        a, b = sorted((find(x), find(y)))
        if a != b:
            root[b] = a
            kept.append(i)
            merges.append((a, b, d))
    return kept, merges


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["d", "a", "b"], ignore_index=True)
    return rows.iloc[_kruskal(rows)[0]][["cluster", "a", "b", "d"]]


def _merges(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["d", "a", "b"], ignore_index=True)
    return pd.DataFrame(_kruskal(rows)[1], columns=["a", "b", "height"])


def linkage_tree(pairs: DataFrame, most: int = FOREST_EDGES) -> DataFrame:
    """Merges (a: smaller name, b: larger name, height) of the single-linkage tree, by Kruskal's rule; a part is named by its
    smallest id.

    Each component is split into parts of about `most` edges, and only the edges of a part's minimum spanning forest are kept, until a
    component is one
    part; its merges are then read off in one task. So no task holds more than `most` edges or two edges for each accession of one
    component, and none reach the driver."""
    edges = pairs.select("a", "b", "d").filter("a <> b and d is not null")
    parts = components(edges).withColumnRenamed("id", "a")
    rows = checkpoint(edges.join(parts, "a").select("cluster", "a", "b", "d"))
    spread = None
    while True:
        # half as many parts each time, and no more than the edges left ask for
        sizes = rows.groupBy("cluster").agg(F.ceil(F.count("*") / most).alias("parts"))
        largest = sizes.agg(F.max("parts")).first()[0] or 1
        if largest == 1 or spread == 1:
            break
        spread = int(largest if spread is None else max(1, min(largest, spread // 2)))
        lot = F.pmod(F.xxhash64("a", "b"), F.least("parts", F.lit(spread)))
        dealt = rows.join(checkpoint(sizes), "cluster").withColumn("lot", lot)
        rows = checkpoint(dealt.groupBy("cluster", "lot").applyInPandas(_forest, "cluster string, a string, b string, d double"))
    return rows.groupBy("cluster").applyInPandas(_merges, "a string, b string, height double")


def newick(merges: list[tuple[str, str, float]]) -> list[str]:
    """The merges as trees in Newick's form, one for each component."""
    trees: dict[str, str] = {}
    height: dict[str, float] = {}
    for a, b, d in merges:
        left, right = trees.pop(a, a), trees.pop(b, b)
        trees[a] = f"({left}:{(d - height.get(a, 0)) / 2:g},{right}:{(d - height.get(b, 0)) / 2:g})"
        height[a] = d
    return [f"{t};" for _, t in sorted(trees.items())]
