"""Checks of recorded pedigrees and the search for better parent pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.functions.masks import NAMES, pack
from genoquery.operators.candidates import MAX_CANDIDATES, MAX_HGMR, candidates, recorded_candidates, top_candidates
from genoquery.operators.phasing import parent_crossovers
from genoquery.operators.prefix import running
from genoquery.operators.triples import statistics, with_masks

MAX_FTR, OK_FTR, SOLUTIONS = 0.5, 0.025, 3
STATISTICS = ("n_good", "agmr12", "hgmr1", "r1", "hgmr2", "r2", "ftr")


def candidate_pairs(found: DataFrame) -> DataFrame:
    """Q1: all unordered pairs with repetition of one progeny's candidates (prog, par, rank): prog, p1, p2 with p1's rank at most p2's.
    Ranks bound a progeny's candidates, so its pairs are bounded too."""
    one, two = found.select(
        "prog", F.col("par").alias("p1"), F.col("rank").alias("r1")
    ), found.select("prog", F.col("par").alias("p2"), F.col("rank").alias("r2"))
    return one.join(two, "prog").filter("r1 <= r2").select("prog", "p1", "p2")


def rank_pairs(rows: DataFrame, by: str = "ftr", max_ftr: float = MAX_FTR, most: int = SOLUTIONS) -> DataFrame:
    """Q2 to Q4: the best `most` pairs of each progeny with ftr at most max_ftr (undefined counts as 100), by ftr or by the larger hgmr,
    then p1, then p2."""
    key = F.coalesce("ftr", F.lit(100.0)) if by == "ftr" else F.coalesce(F.greatest("hgmr1", "hgmr2"), F.lit(100.0))
    rank = F.row_number().over(Window.partitionBy("prog").orderBy(key, "p1", "p2"))
    return rows.filter(F.coalesce("ftr", F.lit(100.0)) <= max_ftr).withColumn("rank", rank).filter(F.col("rank") <= most)


def pedigree_test(genotypes: DataFrame, pedigrees: DataFrame) -> DataFrame:
    """Q11: recorded pedigrees (prog, p1, p2) of genotyped progeny with each statistic and its denominator, and the progeny's missing
    dosages."""
    wide = checkpoint(pack(genotypes))
    rows = statistics(with_masks(pedigrees.select("prog", F.col("fpar").alias("p1"), F.col("mpar").alias("p2")), wide), denominators=True)
    return rows.join(wide.select(F.col("acc_id").alias("prog"), F.col("n_missing").alias("md")), "prog")


_PAIR_ROWS = "prog string, p1 string, p2 string"
PAIR_CELLS = 1 << 18


def _best_of_one(max_ftr: float, most: int):
    """The best pairs of one progeny's candidates, in numpy; rows of the triangle of pairs are taken in strips of about PAIR_CELLS pairs."""

    def masks(rows: pd.DataFrame, names) -> list[np.ndarray]:
        return [np.array(rows[n].tolist(), dtype=np.int64).view(np.uint64) for n in names]

    def run(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(found):
            return pd.DataFrame(np.empty((0, 3), object), columns=["prog", "p1", "p2"])
        found = found.sort_values("rank", ignore_index=True)
        k, c, names = [x[0] for x in masks(own, [f"k_{n}" for n in NAMES])], masks(found, NAMES), found["par"].to_numpy()
        n, words = c[0].shape
        best: list[tuple] = []
        strip = max(1, PAIR_CELLS // n)
        for lo in range(0, n, strip):
            hi = min(n, lo + strip)
            known, forbidden = np.zeros((hi - lo, n - lo), np.int32), np.zeros((hi - lo, n - lo), np.int32)
            for w in range(words):
                i0, i1, i2 = (x[lo:hi, w][:, None] for x in c)
                j0, j1, j2 = (x[lo:, w][None, :] for x in c)
                k0, k1, k2 = (x[w] for x in k)
                both = (i0 | i1 | i2) & (j0 | j1 | j2) & (k0 | k1 | k2)
                h0, h2 = i0 & j0, i2 & j2
                known += np.bitwise_count(both)
                forbidden += np.bitwise_count(((k2 & (i0 | j0)) | (k0 & (i2 | j2))) & both)
                forbidden += np.bitwise_count((h0 | h2) & k1)
                forbidden += np.bitwise_count((h0 & k2) | (h2 & k0))
            ftr = np.where(known > 0, forbidden / np.maximum(known, 1), 100.0)
            x, y = np.nonzero((ftr <= max_ftr) & (np.arange(lo, n)[None, :] >= np.arange(lo, hi)[:, None]))
            if len(x):
                scores, one, two = ftr[x, y], names[lo + x], names[lo + y]
                if len(scores) > most:  # nothing above the most-th score can be among the best
                    near = scores <= np.partition(scores, most - 1)[most - 1]
                    scores, one, two = scores[near], one[near], two[near]
                best = sorted([*best, *zip(scores.tolist(), one.tolist(), two.tolist(), strict=True)])[:most]
        prog = own["prog"].iloc[0]
        return pd.DataFrame(np.array([(prog, one, two) for _, one, two in best], object).reshape(-1, 3), columns=["prog", "p1", "p2"])

    return run


def best_pairs(found: DataFrame, wide: DataFrame, max_ftr: float = MAX_FTR, most: int = SOLUTIONS) -> DataFrame:
    """Q1, Q2, Q4 in one: the best `most` pairs (prog, p1, p2) by ftr, p1, p2 of each progeny's ranked candidates. A candidate's masks go
    to its
    progeny's task once, and only the best pairs become rows; ranks bound a task's candidates."""
    own = wide.select(
        F.col("acc_id").alias("prog"), *(F.col(n).alias(f"k_{n}") for n in NAMES)
    ).join(found.select("prog").distinct(), "prog", "left_semi")
    each = found.select("prog", "par", "rank").join(wide.select(F.col("acc_id").alias("par"), *NAMES), "par")
    return own.groupBy("prog").cogroup(each.groupBy("prog")).applyInPandas(_best_of_one(max_ftr, most), _PAIR_ROWS)


def check_pedigrees(genotypes: DataFrame, pedigrees: DataFrame, phased: bool = True, wide: DataFrame | None = None) -> DataFrame:
    """Q5: a row for each genotyped progeny with a genotyped recorded parent: prog, fpar, mpar, statistics, and crossovers if phased."""
    wide = wide if wide is not None else pack(genotypes)
    known = genotypes.select("acc_id").distinct()
    rows = pedigrees
    for c in ("fpar", "mpar"):
        rows = rows.join(
            known.select(F.col("acc_id").alias(f"__{c}")), F.col(c) == F.col(f"__{c}"), "left"
        ).withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    rows = rows.filter("fpar is not null or mpar is not null").select("prog", F.col("fpar").alias("p1"), F.col("mpar").alias("p2"))
    out = statistics(with_masks(rows, wide))
    out = parent_crossovers(genotypes, out) if phased else out
    return out.withColumnsRenamed({"p1": "fpar", "p2": "mpar"})


def alternatives(
    genotypes: DataFrame, found: DataFrame, max_ftr: float = MAX_FTR, most: int = SOLUTIONS, max_candidates: int = MAX_CANDIDATES,
    phased: bool = True, wide: DataFrame | None = None
) -> DataFrame:
    """The best parent pairs from candidates (prog, par, hgmr); statistics and crossovers are counted for those only."""
    wide = wide if wide is not None else checkpoint(pack(genotypes))
    pairs = checkpoint(best_pairs(top_candidates(found, max_candidates), wide, max_ftr, most))
    best = rank_pairs(statistics(with_masks(pairs, wide)), max_ftr=max_ftr, most=most)
    return parent_crossovers(genotypes, checkpoint(best)) if phased else best


def find_parents(
    genotypes: DataFrame, pedigrees: DataFrame | None, level: int = 0, roles: DataFrame | None = None, max_hgmr: float = MAX_HGMR,
    max_ftr: float = MAX_FTR, ok_ftr: float = OK_FTR, most: int = SOLUTIONS, max_candidates: int = MAX_CANDIDATES, phased: bool = True
) -> DataFrame:
    """Q5 to Q8: the recorded pedigree (kind P) and alternatives (kind A, by rank) of each accession.

    Level 0: recorded pedigrees only. 1: alternatives for all accessions. 2: for those whose recorded pair has an ftr above ok_ftr or
    undefined. 3: for all, from recorded parents only. Without pedigrees: alternatives for all. At levels 1 and 3 accessions
    without a pedigree have a P row of nulls, and those without any alternative an A row of nulls with rank 0.
    """
    wide = checkpoint(pack(genotypes))
    cross = ["x_f", "nhet_f", "x_m", "nhet_m", "acc"] if phased else []
    columns = ["prog", "kind", "rank", "fpar", "mpar", *STATISTICS, *cross]
    everyone = genotypes.select(F.col("acc_id").alias("prog")).distinct()
    recorded = None
    if pedigrees is not None:
        recorded = check_pedigrees(
            genotypes, pedigrees, phased, wide
        ).withColumn("kind", F.lit("P")).withColumn("rank", F.lit(0)).select(*columns)
        if level == 0:
            return recorded
    found = candidates(genotypes, roles, max_hgmr)
    asked = everyone
    if pedigrees is not None and level == 3:
        found = recorded_candidates(found, pedigrees)
    if pedigrees is not None and level == 2:
        asked = recorded.filter(F.coalesce("ftr", F.lit(100.0)) > ok_ftr).select("prog")
        found = found.join(asked, "prog", "left_semi")
    best = alternatives(genotypes, found, max_ftr, most, max_candidates, phased, wide)
    best = best.withColumnsRenamed({"p1": "fpar", "p2": "mpar"}).withColumn("kind", F.lit("A")).select(*columns)
    nothing = asked.join(best.select("prog").distinct(), "prog", "left_anti").select(
        "prog", F.lit("A").alias("kind"), F.lit(0).alias("rank")
    )
    out = best.unionByName(nothing, allowMissingColumns=True)
    if recorded is not None:
        out = out.unionByName(recorded)
        if level in (1, 3):
            out = out.unionByName(
                everyone.join(recorded.select("prog"), "prog", "left_anti").select(
                    "prog", F.lit("P").alias("kind"), F.lit(0).alias("rank")
                ),
                allowMissingColumns=True
            )
    return out.select(*columns)


def other_pairs(genotypes: DataFrame, found: DataFrame, pedigrees: DataFrame, most: int = 80) -> DataFrame:
    """Q12: all pairs of a progeny's best candidates and recorded parents but the recorded pair, with their statistics."""
    named = pedigrees.select("prog", F.explode(F.array("fpar", "mpar")).alias("par")).filter("par is not null")
    best = top_candidates(found, most).select("prog", "par").join(
        pedigrees.select("prog"), "prog", "left_semi"
    ).unionByName(named).distinct()
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("prog").orderBy("par")))
    pair = pedigrees.filter("fpar is not null and mpar is not null").select(
        "prog", F.least("fpar", "mpar").alias("p1"), F.greatest("fpar", "mpar").alias("p2")
    )
    return statistics(with_masks(candidate_pairs(ranked).join(pair, ["prog", "p1", "p2"], "left_anti"), pack(genotypes)))


def wide_output(rows: DataFrame, most: int = SOLUTIONS) -> DataFrame:
    """Q9: one row per progeny: the recorded pair's columns, then each alternative's with a suffix."""
    out = rows.filter("kind = 'P'").drop("kind", "rank")
    own = [c for c in out.columns if c != "prog"]
    for k in range(1, most + 1):
        part = rows.filter((F.col("kind") == "A") & (F.col("rank") == k)).select("prog", *(F.col(c).alias(f"{c}_{k}") for c in own))
        out = out.join(part, "prog", "full")
    return out


def normalizing_means(genotypes: DataFrame, samples: int = 100_000, seed: int = 1) -> dict[str, float]:
    """H9: means of hgmr, r, ftr and z over random triples (parents differ from the progeny), chosen by hash. Accessions are numbered in
    order of ids."""
    rows = checkpoint(running(genotypes.select("acc_id").distinct(), "acc_id", {"k": F.lit(1)}))
    n = rows.count()
    if n < 2:
        return {}
    number = lambda what, m: F.expr(f"cast(conv(substring(md5(concat_ws(':', '{seed}', '{what}', id)), 1, 8), 16, "
        f"10) as bigint) % {m}")  # noqa: E731
    picks = genotypes.sparkSession.range(samples).withColumn("o", number("o", n) + 1)
    for c in ("a", "b"):
        picks = picks.withColumn(c, F.pmod(F.col("o") + number(c, n - 1), F.lit(n)) + 1)
    for c, name in (("o", "prog"), ("a", "p1"), ("b", "p2")):
        picks = picks.join(rows.select(F.col("k").alias(c), F.col("acc_id").alias(name)), c)
    s = statistics(with_masks(picks.select("prog", "p1", "p2"), pack(genotypes)))
    row = s.agg(
        F.avg("hgmr1").alias("hgmr"), F.avg("r1").alias("r"), F.avg("ftr").alias("ftr"), F.avg("z").alias("z"),
        F.avg("ftr_n").alias("ftc")
    ).first()
    return row.asDict()
