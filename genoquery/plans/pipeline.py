"""Whole runs, from VCF or matrix lines to duplicates and parents, with every step's parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.operators import clusters, dedup, filters, histogram, pairs, parents
from genoquery.operators.cluster1d import auto_threshold
from genoquery.sources import matrix, vcf


@dataclass(frozen=True)
class Parameters:
    """Defaults of the chain; `threshold` None chooses it from the distances."""

    min_gp: float = 0.9
    chunk_size: int = 7
    max_marker_missing: float = 0.25
    max_accession_missing: float = 0.5
    min_maf: float = 0.05
    max_distance: float = 0.2
    exact: bool = True
    threshold: float | None = clusters.THRESHOLD
    prune: float = clusters.PRUNE
    vote: bool = False
    level: int = 0
    seed: int = 1


#: The stand-alone search for duplicates has other defaults.
FINDER = Parameters(chunk_size=6, min_maf=0.08, max_accession_missing=0.2, threshold=None)


def load(lines: DataFrame, p: Parameters) -> DataFrame:
    """Genotypes from either format, with markers in order of chromosome, position and id."""
    if matrix.sniff(lines) == "matrix":
        rows = matrix.parse(lines)
    else:
        rows = vcf.parse(lines, None, vcf.Options(min_gp=p.min_gp))
        order = F.row_number().over(Window.orderBy("chrom", "pos", "marker_id")) - 1  # one row per marker
        markers = rows.select("marker_id", "chrom", "pos").distinct().withColumn("marker", order)
        rows = rows.join(markers.select("marker_id", "marker"), "marker_id").select(
            "acc_id", "marker", "marker_id", "chrom", "dosage", "phase"
        )
    good = filters.accession_filter(rows, p.max_accession_missing)
    return checkpoint(filters.marker_filter(good, p.max_marker_missing, p.min_maf))


def find_duplicates(lines: DataFrame, p: Parameters = FINDER) -> dict[str, DataFrame]:
    """Genotypes, pairs, members, clusters, and a histogram of the distances."""
    g = load(lines, p)
    found = pairs.similar_pairs(g, p.max_distance) if p.exact else pairs.filtered_pairs(g, p.max_distance, p.chunk_size, seed=p.seed)
    missing = g.groupBy("acc_id").agg(F.count_if(F.col("dosage").isNull()).alias("md"))
    found = checkpoint(found.select("q_id", "m_id", "agmr", "hgmr"))
    loaded = clusters.load_pairs(found.select(F.col("q_id").alias("id1"), F.col("m_id").alias("id2"), F.col("agmr").alias("d")))
    threshold = p.threshold
    if threshold is None:
        best = auto_threshold(loaded.select(F.col("d").alias("x")))
        threshold = clusters.THRESHOLD if best is None else best
    own = checkpoint(clusters.members(loaded, missing.withColumnRenamed("acc_id", "id"), threshold, p.prune))
    values = loaded.select(F.col("d").alias("x"))
    return {
        "genotypes": g, "pairs": found, "members": own, "clusters": clusters.ordered(clusters.cluster_table(loaded, own, threshold)),
        "histogram": histogram.histogram(values, histogram.Bins(0.0, p.max_distance, 0.002))
    }


def vcf_to_parents(lines: DataFrame, pedigrees: DataFrame | None = None, p: Parameters = Parameters()) -> dict[str, DataFrame]:
    """Duplicates are found and reduced to one accession each, in genotypes and pedigrees; then recorded parents are checked and
    others looked for."""
    out = find_duplicates(lines, p)
    g, own = out["genotypes"], out["members"]
    kept = dedup.unique_genotypes(g, own)
    if p.vote:
        voted = dedup.vote(g, own).withColumnRenamed("dosage", "__v")
        kept = kept.join(voted, ["acc_id", "marker"], "left").withColumn("__in", F.col("acc_id").isin([]))
        reps = dedup.representatives(own).select(F.col("rep").alias("acc_id")).distinct().withColumn("__r", F.lit(True))
        kept = kept.join(reps, "acc_id", "left").withColumn(
            "phase", F.when(F.col("__r") & ~F.col("__v").eqNullSafe(F.col("dosage")), None).otherwise(F.col("phase"))
        ).withColumn("dosage", F.when(F.col("__r"), F.col("__v")).otherwise(F.col("dosage"))).drop("__v", "__in", "__r")
    kept = checkpoint(kept)
    records = None
    if pedigrees is not None:
        records = checkpoint(
            dedup.unique_pedigrees(pedigrees if "line" in pedigrees.columns else pedigrees.withColumn("line", F.col("prog")), own)
        )
    return out | {"unique": kept, "pedigrees": records, "parents": parents.find_parents(kept, records, p.level)}
