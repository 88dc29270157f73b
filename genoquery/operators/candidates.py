"""Candidate parents of each accession by homozygous mismatch rate, with roles.

Roles: p (parent only), o (offspring only), b (both), n (neither).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoquery.functions.masks import NAMES, bits, pack
from genoquery.functions.ratios import ratio, tally
from genoquery.operators.counts import accession_counts
from genoquery.operators.filters import marker_counts
from genoquery.operators.pairs import related_pairs

MAX_HGMR, MAX_CANDIDATES = 0.05, 1000


def roles_by_heterozygosity(genotypes: DataFrame, low: float = 0.02, range_factor: float = 1.0, least: int = 100) -> DataFrame:
    """H3: of accessions with more than `least` known dosages those at or below `low` are p, those at or above low * range_factor o, the
    rest b."""
    het, known = F.col("heterozygosity"), F.col("n0") + F.col("n1") + F.col("n2")
    role = F.when(known <= least, "b").when(het <= low, "p").when(het >= low * range_factor, "o").otherwise("b")
    return accession_counts(genotypes).select("acc_id", role.alias("role"))


def roles_by_pedigree(accessions: DataFrame, pedigrees: DataFrame) -> DataFrame:
    """H4: recorded parents can be parents (b), others can't (o)."""
    parents = pedigrees.select(
        F.explode(F.array("fpar", "mpar")).alias("acc_id")
    ).filter("acc_id is not null").distinct().withColumn("__p", F.lit(True))
    return accessions.select("acc_id").distinct().join(parents, "acc_id", "left").select(
        "acc_id", F.when(F.col("__p"), "b").otherwise("o").alias("role")
    )


def directed(pairs: DataFrame) -> DataFrame:
    """(prog, par, n11, hgmr) in both directions."""
    return pairs.select(F.col("q_id").alias("prog"), F.col("m_id").alias("par"), "n11", "hgmr").unionByName(
        pairs.select(F.col("m_id").alias("prog"), F.col("q_id").alias("par"), "n11", "hgmr")
    )


def candidates(genotypes: DataFrame, roles: DataFrame | None = None, max_hgmr: float = MAX_HGMR, mean_hgmr: float = 1.0) -> DataFrame:
    """H1, H2: prog, par, n11, hgmr (over the mean) of every ordered pair that roles allow and whose hgmr is small enough, inclusively.
    Without roles all are b."""
    rows = directed(related_pairs(genotypes, max_hgmr * mean_hgmr)).withColumn("hgmr", F.col("hgmr") / mean_hgmr)
    if roles is not None:
        can = lambda c, allowed: roles.filter(F.col("role").isin(*allowed)).select(F.col("acc_id").alias(c))
        rows = rows.join(can("prog", "ob"), "prog", "left_semi").join(can("par", "pb"), "par", "left_semi")
    return rows


def recorded_candidates(found: DataFrame, pedigrees: DataFrame) -> DataFrame:
    """H5: candidates that some pedigree names as a parent."""
    parents = pedigrees.select(F.explode(F.array("fpar", "mpar")).alias("par")).filter("par is not null").distinct()
    return found.join(parents, "par", "left_semi")


def candidates_of(found: DataFrame, accessions: DataFrame) -> DataFrame:
    """H6: candidates of some accessions only."""
    return found.join(accessions.select(F.col("acc_id").alias("prog")).distinct(), "prog", "left_semi")


def paired(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (prog, par), each once, with the masks of both as structs k and i: one row of words a pair instead of one row a marker."""
    wide = pack(genotypes).select("acc_id", F.struct(*NAMES).alias("x"))
    rows = pairs.select("prog", "par").distinct()
    for c, name in (("prog", "k"), ("par", "i")):
        rows = rows.join(wide.select(F.col("acc_id").alias(c), F.col("x").alias(name)), c)
    return rows


def pair_tallies(rows: DataFrame, **conditions) -> DataFrame:
    """prog, par and the number of markers that meet each condition, given as an expression of words: get('k.m0') and so on; k is the
    progeny, i the parent.
    Pairs without a marker known in both are left out."""
    any_ = lambda get, s: get(f"{s}.m0").bitwiseOR(get(f"{s}.m1")).bitwiseOR(get(f"{s}.m2"))
    known = bits(F.col("k.m0"), lambda get: any_(get, "k").bitwiseAND(any_(get, "i")))
    return rows.filter(known > 0).select(
        "prog", "par", *(bits(F.col("k.m0"), lambda get, f=f: f(get, lambda s: any_(get, s))).alias(n) for n, f in conditions.items())
    )


def het_overlap(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Markers heterozygous in both, and in each with the other known, of given pairs (prog, par)."""
    return pair_tallies(
        paired(genotypes, pairs),
        n11=lambda get, known: get("k.m1").bitwiseAND(get("i.m1")),
        n_het_prog=lambda get, known: get("k.m1").bitwiseAND(known("i")),
        n_het_par=lambda get, known: get("i.m1").bitwiseAND(known("k")),
    )


def reject_het_het(found: DataFrame, overlap: DataFrame, least: int = 100, share: float = 0.05) -> DataFrame:
    """H7: candidates whose parent has fewer than `least` heterozygous markers, or shares more than `share` of them."""
    good = overlap.filter((F.col("n_het_par") < least) | (F.col("n11") > share * F.col("n_het_par"))).select("prog", "par")
    return found.join(good, ["prog", "par"], "left_semi")


def top_candidates(found: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """H8: at most `most` candidates of each accession, by hgmr, then id, with their rank."""
    rank = F.row_number().over(Window.partitionBy("prog").orderBy("hgmr", "par"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def generalized_hgmr(genotypes: DataFrame, pairs: DataFrame, ploidy: int = 2) -> DataFrame:
    """For any ploidy: forbidden if dosages differ by more than half the ploidy, over markers where neither is half of it. Diploids
    go by masks."""
    if ploidy == 2:
        apart = lambda get, known: get("k.m0").bitwiseAND(get("i.m2")).bitwiseOR(get("k.m2").bitwiseAND(get("i.m0")))
        same = lambda get, known: get("k.m0").bitwiseAND(get("i.m0")).bitwiseOR(get("k.m2").bitwiseAND(get("i.m2")))
        counted = pair_tallies(paired(genotypes, pairs), n=apart, s=same).select("prog", "par", "n", (F.col("n") + F.col("s")).alias("d"))
        return counted.withColumn("hgmr", ratio("n", "d"))
    own = genotypes.filter("dosage is not null").select("acc_id", "marker", "dosage")
    rows = pairs.select("prog", "par").distinct().join(own.withColumnsRenamed({"acc_id": "prog", "dosage": "k"}), "prog").join(
        own.select(F.col("acc_id").alias("par"), "marker", F.col("dosage").alias("i")), ["par", "marker"]
    )
    counted = rows.groupBy("prog", "par").agg(
        tally(2 * F.abs(F.col("k") - F.col("i")) > ploidy).alias("n"),
        tally((2 * F.col("k") != ploidy) & (2 * F.col("i") != ploidy)).alias("d")
    )
    return counted.withColumn("hgmr", ratio("n", "d"))


def expected_hgmr(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Opposite homozygotes seen, over those expected from marker frequencies where the parent is homozygous. Frequencies weigh
    markers, so the
    masks are unpacked in the task: one row a pair, and the weights once (two numbers a marker)."""
    known = F.col("n0") + F.col("n1") + F.col("n2")
    share = marker_counts(genotypes).select(
        (F.col("marker")).alias("m"), F.coalesce(ratio("n0", known), F.lit(0.0)).alias("f0"),
        F.coalesce(ratio("n2", known), F.lit(0.0)).alias("f2")
    )
    rows = paired(genotypes, pairs)
    rows = rows.crossJoin(F.broadcast(share.agg(F.sort_array(F.collect_list(F.struct("m", "f0", "f2"))).alias("f"))))  # a row with two numbers a marker, as a mask has bits
    get = lambda n: f"getbit(element_at({n}, cast(x.m div 64 as int) + 1), cast(x.m % 64 as int))"
    chance = f"case when {get('k.m0')} + {get('k.m1')} + {get('k.m2')} = 0 then 0D when {get('i.m0')} = 1 then x.f2 when {get('i.m2')} = 1 then x.f0 else 0D end"
    expected = F.expr(f"aggregate(f, 0D, (s, x) -> s + {chance})")
    any_ = lambda get_, s: get_(f"{s}.m0").bitwiseOR(get_(f"{s}.m1")).bitwiseOR(get_(f"{s}.m2"))
    both = bits(F.col("k.m0"), lambda g: any_(g, "k").bitwiseAND(any_(g, "i")))
    seen = bits(F.col("k.m0"), lambda g: g("k.m0").bitwiseAND(g("i.m2")).bitwiseOR(g("k.m2").bitwiseAND(g("i.m0"))))
    counted = rows.filter(both > 0).select("prog", "par", seen.alias("seen"), expected.alias("expected"))
    return counted.select(
        "prog", "par", "seen", F.round("expected", 6).alias("expected"),
        F.when(F.col("expected") > 0, F.round(F.col("seen") / F.nullif(F.col("expected"), F.lit(0.0)), 6)).alias("xhgmr")
    )
