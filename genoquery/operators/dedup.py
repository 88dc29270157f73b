"""One accession per cluster in genotype and pedigree tables.

Clusters are rows (cluster, id, rank); rank 1 is the representative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoquery.functions.hashing import uniform
from genoquery.functions.ratios import tally


def representatives(found: DataFrame) -> DataFrame:
    """(id, rep) for every member of a cluster of two or more."""
    rep = found.filter("rank = 1").select("cluster", F.col("id").alias("rep"))
    many = found.groupBy("cluster").agg(F.count("*").alias("k")).filter("k > 1").select("cluster")
    return found.select("cluster", "id").join(many, "cluster", "left_semi").join(rep, "cluster").select("id", "rep")


def unique_genotypes(genotypes: DataFrame, found: DataFrame) -> DataFrame:
    """Genotypes without the members that don't represent their cluster."""
    gone = representatives(found).filter("id <> rep").select(F.col("id").alias("acc_id"))
    return genotypes.join(gone, "acc_id", "left_anti")


def keep_share(genotypes: DataFrame, found: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """As U2, but a repeatable random share of the duplicates stays too."""
    gone = representatives(found).filter("id <> rep").filter(uniform(seed, "id") >= share)
    return genotypes.join(gone.select(F.col("id").alias("acc_id")), "acc_id", "left_anti")


def vote(genotypes: DataFrame, found: DataFrame) -> DataFrame:
    """The representatives' genotypes by vote of their clusters. Of two members: equal dosages stand, one missing yields to the other,
    a disagreement is missing. Of more: a dosage needs over half of the cluster, missing ones included. Signs of phase don't matter and
    are dropped."""
    reps = representatives(found).withColumnRenamed("id", "acc_id")
    size = reps.groupBy("rep").agg(F.count("*").alias("k"))
    rows = genotypes.join(reps, "acc_id").groupBy("rep", "marker").agg(
        *(tally(f"dosage = {d}").alias(f"n{d}") for d in (0, 1, 2))
    ).join(size, "rep")
    lone = F.expr(
        "case when (n0 > 0 and n1 + n2 > 0) or (n1 > 0 and n2 > 0) then null when n0 > 0 then 0 when n1 > 0 then 1 when n2 > 0 then 2 end"
    )
    most = F.expr("case when 2 * n0 > k then 0 when 2 * n1 > k then 1 when 2 * n2 > k then 2 end")
    return rows.select(F.col("rep").alias("acc_id"), "marker", F.when(F.col("k") == 2, lone).otherwise(most).alias("dosage"))


def voted_genotypes(genotypes: DataFrame, found: DataFrame) -> DataFrame:
    """(acc_id, marker, dosage) of accessions outside clusters, and the votes of those inside."""
    inside = representatives(found).select(F.col("id").alias("acc_id"))
    return genotypes.join(inside, "acc_id", "left_anti").select("acc_id", "marker", "dosage").unionByName(vote(genotypes, found))


def unique_pedigrees(pedigrees: DataFrame, found: DataFrame, order: str = "line") -> DataFrame:
    """Pedigrees (order, prog, fpar, mpar) between representatives. Of records with the same raw progeny id the first counts;
    records without progeny or any parent go; of a representative's records the one with fewer unknown parents stays, then the first."""
    first = F.row_number().over(Window.partitionBy("prog").orderBy(order))
    rows = pedigrees.filter("prog is not null").withColumn("__k", first).filter("__k = 1 and (fpar is not null or mpar is not null)")
    reps = representatives(found)
    for c in ("prog", "fpar", "mpar"):
        named = reps.select(F.col("id").alias(c), F.col("rep").alias(f"__{c}"))
        rows = rows.join(named, c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    unknown = F.col("fpar").isNull().cast("int") + F.col("mpar").isNull().cast("int")
    best = F.row_number().over(Window.partitionBy("prog").orderBy(unknown, order))
    return rows.withColumn("__k", best).filter("__k = 1").select("prog", "fpar", "mpar")


def consensus_tally(genotypes: DataFrame, found: DataFrame) -> DataFrame:
    """U8: over all clusters, per marker, how many dosages agree with their cluster's commonest, differ, or are missing. Of equally common
    ones the smaller wins."""
    reps = representatives(found).withColumnRenamed("id", "acc_id")
    per = genotypes.join(reps, "acc_id").groupBy("rep", "marker").agg(
        *(tally(f"dosage = {d}").alias(f"n{d}") for d in (0, 1, 2)), tally("dosage is null").alias("nx")
    )
    top = F.greatest("n0", "n1", "n2")
    return per.groupBy("marker").agg(
        F.sum(top).alias("winners"), F.sum(F.col("n0") + F.col("n1") + F.col("n2") - top).alias("others"), F.sum("nx").alias("missing")
    )
