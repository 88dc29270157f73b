"""Filters on accessions and markers, sampling, and column and id utilities.

Genotypes are rows (acc_id, marker, marker_id, chrom, dosage, phase); a missing dosage is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoquery.functions.hashing import uniform
from genoquery.functions.ratios import tally


def accession_filter(genotypes: DataFrame, max_missing: float = 1.0) -> DataFrame:
    """genotypes of accessions whose missing dosages are at most max_missing of their markers."""
    return _split_accessions(genotypes, max_missing)[0]


def rejected_accessions(genotypes: DataFrame, max_missing: float = 1.0) -> DataFrame:
    return _split_accessions(genotypes, max_missing)[1]


def _split_accessions(genotypes: DataFrame, max_missing: float) -> tuple[DataFrame, DataFrame]:
    good = genotypes.groupBy("acc_id").agg(
        F.count("*").alias("n"), tally("dosage is null").alias("x")
    ).filter(F.col("x") <= max_missing * F.col("n")).select("acc_id")
    return genotypes.join(good, "acc_id", "left_semi"), genotypes.join(good, "acc_id", "left_anti")


def marker_counts(genotypes: DataFrame) -> DataFrame:
    """A2, A3: per marker the accessions, missing dosages, alt alleles and dosages 0, 1, 2."""
    return genotypes.groupBy("marker").agg(
        F.first("marker_id").alias("marker_id"), F.first("chrom").alias("chrom"), F.count("*").alias("n_acc"), tally("dosage is null").alias("n_missing"),
        F.coalesce(F.sum("dosage"), F.lit(0)).cast("bigint").alias("n_alt"), *(tally(f"dosage = {d}").alias(f"n{d}") for d in (0, 1, 2)),
    )


def missing_threshold(genotypes: DataFrame, factor: float) -> float:
    """factor times the (upper) median of the markers' missing fractions, for a negative max_missing."""
    counts = marker_counts(genotypes).groupBy("n_missing").agg(F.count("*").alias("k"), F.max("n_acc").alias("n_acc"))
    total = F.sum("k").over(Window.partitionBy())
    upto = F.sum("k").over(Window.orderBy("n_missing"))
    row = counts.select("n_missing", "n_acc", upto.alias("c"), total.alias("t")).filter("c > t / 2").orderBy("n_missing").first()
    return abs(factor) * row["n_missing"] / row["n_acc"] if row else abs(factor)


def marker_filter(genotypes: DataFrame, max_missing: float = 0.25, min_maf: float = 0.05, ploidy: int = 2) -> DataFrame:
    """genotypes of markers with few missing dosages and an alt frequency within [min_maf, 1 - min_maf], all bounds inclusive; markers
    are numbered anew from 0."""
    if max_missing < 0:
        max_missing = missing_threshold(genotypes, max_missing)
    known = ploidy * (F.col("n_acc") - F.col("n_missing"))
    good = marker_counts(genotypes).filter(
        (
            F.col("n_missing") <= max_missing * F.col("n_acc")
        ) & (F.col("n_alt") >= known * min_maf) & (F.col("n_alt") <= known * (1 - min_maf))
    )
    dense = good.select("marker", (F.row_number().over(Window.orderBy("marker")) - 1).alias("__dense"))  # one row per marker
    return genotypes.join(dense, "marker").withColumn("marker", F.col("__dense")).select(*genotypes.columns)


def thin_markers(genotypes: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """a repeatable random share of the markers."""
    return genotypes.filter(uniform(seed, "marker_id") < fraction)


def rectify_markers(genotypes: DataFrame) -> DataFrame:
    """markers whose alt frequency is above a half have alleles swapped, so that 2 is the rarer homozygote."""
    flip = marker_counts(genotypes).select("marker", (F.col("n_alt") > F.col("n_acc") - F.col("n_missing")).alias("__flip"))
    joined = genotypes.join(flip, "marker")
    return joined.withColumn(
        "dosage", F.when(F.col("__flip"), 2 - F.col("dosage")).otherwise(F.col("dosage"))
    ).withColumn("phase", F.when(F.col("__flip"), -F.col("phase")).otherwise(F.col("phase"))).select(*genotypes.columns)


def check_counts(genotypes: DataFrame) -> DataFrame:
    """one row that says whether counts by accession and by marker agree."""
    by_acc = genotypes.groupBy("acc_id").agg(
        *(tally(f"dosage = {d}").alias(f"n{d}") for d in (0, 1, 2)), tally("dosage is null").alias("nx"), F.count("*").alias("n")
    )
    by_marker = genotypes.groupBy("marker").agg(
        *(tally(f"dosage = {d}").alias(f"n{d}") for d in (0, 1, 2)), tally("dosage is null").alias("nx"), F.count("*").alias("n")
    )
    sums = lambda df, p: df.agg(
        *(F.sum(c).alias(f"{p}_{c}") for c in ("n0", "n1", "n2", "nx")), F.min("n").alias(f"{p}_min"), F.max("n").alias(f"{p}_max")
    )
    both = sums(by_acc, "a").join(sums(by_marker, "m"))  # one row on either side
    same = " and ".join(f"a_{c} = m_{c}" for c in ("n0", "n1", "n2", "nx"))
    return both.select(
        F.col("a_n0").alias("n0"), F.col("a_n1").alias("n1"), F.col("a_n2").alias("n2"), F.col("a_nx").alias("nx"),
        F.expr(f"{same} and a_min = a_max and m_min = m_max").alias("consistent")
    )


def select_columns(df: DataFrame, places: list[int]) -> DataFrame:
    """Columns by 1-based place, from the right if negative."""
    return df.select(*(df.columns[p - 1 if p > 0 else p] for p in places))


def sampled(columns: list[str], share: float, seed: int = 1) -> list[str]:
    import zlib

    return [columns[0], *(c for c in columns[1:] if zlib.crc32(f"{seed}:{c}".encode()) < share * 2**32)]


def sample_columns(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """F8: the first column and a repeatable random share of the others."""
    return df.select(*sampled(df.columns, share, seed))


def select_accessions(genotypes: DataFrame, ids: DataFrame) -> DataFrame:
    """Genotypes of the listed accessions."""
    return genotypes.join(ids.select("acc_id").distinct(), "acc_id", "left_semi")


def quadrants(df: DataFrame, x: str, y: str, x_cut: float, y_cut: float) -> DataFrame:
    """df with `quadrant` (L or U for y, then L or R for x; up to a cut is low) or `nan` where a value is missing."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    label = F.concat(F.when(F.col(y) <= y_cut, "L").otherwise("U"), F.when(F.col(x) <= x_cut, "L").otherwise("R"))
    return df.withColumn("quadrant", F.when(known, label).otherwise("nan"))


def distinct_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """the second and later rows of an id get a suffix __2, __3 and so on."""
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return df.withColumn("__k", k).withColumn(
        id_col, F.when(F.col("__k") > 1, F.concat(F.col(id_col), F.lit("__"), F.col("__k").cast("string"))).otherwise(F.col(id_col))
    ).drop("__k")


def sorted_numbers(lines: DataFrame, place: int = 1, separator: str = r"\s+") -> DataFrame:
    """one column of text lines as numbers, ascending; what is no number is skipped."""
    value = F.try_element_at(F.split(F.trim("value"), separator), F.lit(place)).try_cast("double")
    return lines.select(value.alias("x")).filter("x is not null and not isnan(x)").orderBy("x")
