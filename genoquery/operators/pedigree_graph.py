"""Pedigrees as a directed graph, and tables for association studies.

Pedigrees are rows (prog, fpar, mpar); edges go from parent to offspring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.functions.hashing import key, uniform
from genoquery.operators.prefix import running


def edges(pedigrees: DataFrame) -> DataFrame:
    """(parent, child), each once; a selfed child has one edge."""
    return pedigrees.select(
        F.explode(F.array("fpar", "mpar")).alias("parent"), F.col("prog").alias("child")
    ).filter("parent is not null and child is not null").distinct()


def degrees(links: DataFrame) -> DataFrame:
    """Parents and offspring of each accession."""
    up = links.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n_parents"))
    down = links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_offspring"))
    return up.join(down, "id", "full").na.fill(0, ["n_parents", "n_offspring"])


def family_triples(links: DataFrame) -> DataFrame:
    """G1: accessions with both parents (case 1: acc, parent, parent), two offspring (2) or a parent and an offspring (3); every choice is
    a row, not a random one. Case 2 grows with the square of an accession's offspring, by definition."""
    up, down = links.select(
        F.col("child").alias("acc"), F.col("parent").alias("x")
    ), links.select(F.col("parent").alias("acc"), F.col("child").alias("x"))
    second = lambda df: df.withColumnRenamed("x", "y")
    one = up.join(second(up), "acc").filter("x < y").withColumn("case", F.lit(1))
    two = down.join(second(down), "acc").filter("x < y").withColumn("case", F.lit(2))
    three = up.join(second(down), "acc").withColumn("case", F.lit(3))
    return one.unionByName(two).unionByName(three).select("case", "acc", "x", "y")


def random_triples(links: DataFrame, seed: int = 1) -> DataFrame:
    """G1: of each accession and case one triple, by hash: two parents, two different offspring, or a parent and an offspring. The two
    members are
    drawn from the ordered relatives, so no pair of relatives is formed but the one kept."""
    up = links.select(F.col("child").alias("acc"), F.col("parent").alias("x"))
    down = links.select(F.col("parent").alias("acc"), F.col("child").alias("x"))

    def drawn(df: DataFrame, what: str, name: str, other: str | None = None) -> DataFrame:
        """Of each accession one relative, the least by hash; and a second one."""
        lots = df.select("acc", F.struct(key(f"{seed}{what}", "acc", "x").alias("k"), F.col("x")).alias("s")).groupBy("acc").agg(
            F.min_by("s", "s").alias("one"), *([F.max_by("s", "s").alias("two")] if other else [])
        )
        return lots.select("acc", F.col("one.x").alias(name), *([F.col("two.x").alias(other)] if other else []))

    both = lambda df, case: drawn(df, str(case), "a", "b").filter("a <> b").select(
        F.lit(case).alias("case"), "acc", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")
    )
    three = drawn(up, "3u", "x").join(drawn(down, "3d", "y"), "acc").select(F.lit(3).alias("case"), "acc", "x", "y")
    return both(up, 1).unionByName(both(down, 2)).unionByName(three)


def ancestors(links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth) with the least depth, of all ancestors, or up to max_depth. An accession that is its own ancestor is on a
    cycle.

    Depths double: after round r all paths of up to 2^r steps are known, so a pedigree of any depth takes few rounds."""
    found = checkpoint(links.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    reach, n = 1, found.count()
    while max_depth is None or reach < max_depth:
        on = found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        further = found.join(on, "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        more = found.unionByName(further).groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
        found, reach, before = checkpoint(more if max_depth is None else more.filter(F.col("depth") <= max_depth)), 2 * reach, n
        n = found.count()
        if n == before:
            break
    return found


def cycles(links: DataFrame) -> DataFrame:
    """Accessions on a cycle; none if the graph is acyclic. Accessions without parents, or without offspring, are taken off until none
    is left to take; what remains is searched."""
    rest = checkpoint(links)
    n = rest.count()
    while True:
        kept = rest.join(rest.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        rest = checkpoint(kept.join(rest.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"))
        before, n = n, rest.count()
        if n == before:
            break
    return ancestors(rest.select("parent", "child")).filter("id = ancestor").select("id").distinct()


def childless(links: DataFrame) -> DataFrame:
    return links.select(F.col("child").alias("id")).distinct().join(links.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


def grandparents(pedigrees: DataFrame) -> DataFrame:
    """(prog, line, parent, grandparent) with line FF, FM, MF or MM."""
    long = pedigrees.select("prog", F.expr("stack(2, 'F', fpar, 'M', mpar) as (side, parent)")).filter("parent is not null")
    up = long.select(F.col("prog").alias("parent"), F.col("side").alias("above"), F.col("parent").alias("grandparent"))
    return long.join(up, "parent").select("prog", F.concat("side", "above").alias("line"), "parent", "grandparent")


def random_pedigrees(accessions: DataFrame, selfing: bool = False, seed: int = 1) -> DataFrame:
    """Two parents for each accession by hash, neither itself, and the same one twice only if selfing is allowed."""
    numbered = running(accessions.select("acc_id").distinct(), "acc_id", {"k": F.lit(1)})
    rows = checkpoint(numbered.select("acc_id", (F.col("k") - 1).alias("k")))
    n = rows.count()
    if n < 3:
        return rows.select(
            F.col("acc_id").alias("prog"), F.lit(None).cast("string").alias("fpar"), F.lit(None).cast("string").alias("mpar")
        )
    shift = lambda s, m: F.floor(uniform(f"{seed}{s}", "acc_id") * m).cast("bigint")
    first = 1 + shift("f", n - 1)
    second = 1 + shift("m", n - 1) if selfing else 1 + F.pmod(first - 1 + 1 + shift("m", n - 2), F.lit(n - 1))
    picks = rows.select(
        F.col("acc_id").alias("prog"), F.pmod(F.col("k") + first, F.lit(n)).alias("f"), F.pmod(F.col("k") + second, F.lit(n)).alias("m")
    )
    for c, name in (("f", "fpar"), ("m", "mpar")):
        picks = picks.join(rows.select(F.col("k").alias(c), F.col("acc_id").alias(name)), c)
    return picks.select("prog", "fpar", "mpar")


def genome_positions(markers: DataFrame) -> DataFrame:
    """Markers (chrom, pos, ...) with a cumulative position: pos plus the largest positions of all chromosomes before."""
    ends = markers.groupBy("chrom").agg(F.max("pos").alias("end"))
    before = F.coalesce(F.sum("end").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per chromosome
    return markers.join(
        ends.select("chrom", before.alias("offset")), "chrom"
    ).withColumn("cum_pos", F.col("pos") + F.col("offset")).drop("offset")


def add_noise(genotypes: DataFrame, rate: float, seed: int = 1, missing: float = 0.0) -> DataFrame:
    """A repeatable share of dosages is changed to another one, and a share to missing."""
    roll = lambda s: uniform(f"{seed}{s}", "acc_id", "marker")
    other = F.pmod(F.col("dosage") + 1 + F.floor(roll("which") * 2), F.lit(3)).cast("int")
    dosage = F.when(roll("gone") < missing, None).when(roll("noise") < rate, other).otherwise(F.col("dosage"))
    return genotypes.withColumn("dosage", dosage)


def duplicates(genotypes: DataFrame, share: float, rate: float, seed: int = 1) -> DataFrame:
    """Genotypes with noisy copies (suffix _dup) of a repeatable share of the accessions."""
    chosen = genotypes.filter(uniform(seed, "acc_id") < share)
    return genotypes.unionByName(add_noise(chosen, rate, seed).withColumn("acc_id", F.concat("acc_id", F.lit("_dup"))))


def average_phenotypes(rows: DataFrame) -> DataFrame:
    """(acc_id, rep, value) averaged over replicates whose signs are first made to agree with replicate 1's, by the slope of the
    regression on it."""
    first = rows.groupBy("acc_id").agg(F.min(F.struct("rep", "value")).alias("x")).select("acc_id", F.col("x.value").alias("base"))
    slopes = rows.join(first, "acc_id").groupBy("rep").agg(F.regr_slope("value", "base").alias("slope"))
    sign = F.when(F.col("slope") < 0, -1).otherwise(1)
    return rows.join(slopes, "rep").groupBy("acc_id").agg(F.round(F.avg(F.col("value") * sign), 9).alias("value"), F.count("*").alias("n"))
