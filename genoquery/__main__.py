"""Commands: matrix (VCF to dosage matrix), duplicates, clusters, uniquify, parents, histogram; and whole runs: duplicate-finder and
vcf-to-parents. `python -m genoquery COMMAND --help` lists the parameters.

Inputs and outputs are paths that Spark reads and writes; an output is a folder of text files whose names sort in the order of the lines.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.operators import candidates, clusters, cluster1d, dedup, filters, histogram, pairs, parents
from genoquery.plans.pipeline import FINDER, Parameters, find_duplicates, load, vcf_to_parents
from genoquery.sources import matrix, tables, vcf


def lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated lines; undefined values are `-`, ratios have six digits."""
    kinds = dict(df.dtypes)
    shown = [F.format_string("%.6f", c) if kinds[c] == "double" else F.col(c).cast("string") for c in columns]
    return df.select(F.concat_ws("\t", *(F.coalesce(x, F.lit("-")) for x in shown)).alias("value"))


def sorted_lines(df: DataFrame, columns: list[str], order: list) -> DataFrame:
    return lines(df.orderBy(*order), columns)


def genotypes_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return load(
        spark.read.text(a.input),
        Parameters(
            min_gp=a.prob_min, max_marker_missing=a.marker_max_missing_data, max_accession_missing=a.accession_max_missing_data,
            min_maf=a.maf_min
        )
    )


def to_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = vcf.read(spark, a.input, vcf.Options(min_gp=a.prob_min, delta=a.delta, chrom_pos_ids=a.alternate_marker_ids))
    rows = vcf.marker_filter(rows, a.marker_max_missing_data, a.maf_min)
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy("chrom", "pos", "marker_id")) - 1  # one row per marker
    place = rows.select("marker_id", "chrom", "pos").distinct().withColumn("marker", order).select("marker_id", "marker")
    rows = checkpoint(rows.join(place, "marker_id"))
    good, bad = vcf.split_accessions(rows, a.accession_max_missing_data)
    for part, path in ((good, a.output), (bad, a.rejected)):
        if path:
            matrix.to_lines(part, a.seed if a.randomize else None).orderBy("k").select("value").write.text(path)


def duplicates(spark: SparkSession, a: argparse.Namespace) -> None:
    g = genotypes_of(spark, a)
    if a.reference:
        g = matrix.with_reference(
            load(spark.read.text(a.reference), Parameters(max_marker_missing=1.0, max_accession_missing=1.0, min_maf=0.0)), g
        )
    if a.filtered_out:
        matrix.write(g, a.filtered_out)
    exact = pairs.similar_pairs(g, a.distance_max) if a.reference or not a.prefilter else pairs.filtered_pairs(
        g, a.distance_max, a.chunk_size, a.passes, a.seed
    )
    if "q_md" not in exact.columns:
        md = g.groupBy("acc_id").agg(F.count_if(F.col("dosage").isNull()).alias("md"))
        exact = exact.join(
            md.select(F.col("acc_id").alias("q_id"), F.col("md").alias("q_md")), "q_id"
        ).join(md.select(F.col("acc_id").alias("m_id"), F.col("md").alias("m_md")), "m_id")
    columns = ["q_id", "q_md", "m_id", "m_md", "agmr", "hgmr"] + (
        ["usable", "matches", "est_agmr"] if a.format != 1 and "usable" in exact.columns else []
    )
    sorted_lines(exact, columns, ["q_id", "agmr", "m_id"]).write.text(a.output)


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_pairs(spark.read.text(a.input), a.id1col, a.id2col, a.dcolumn)
    rows = checkpoint(rows.withColumn("d", F.pow("d", F.lit(float(a.pow)))) if a.pow != 1 else rows)
    loaded = clusters.load_pairs(rows, a.maxd)
    if a.cluster_distance == "auto":
        best = cluster1d.auto_threshold(loaded.select(F.col("d").alias("x")))
        threshold = clusters.THRESHOLD if best is None else best
    else:
        threshold = float(a.cluster_distance)
    found = checkpoint(clusters.members(loaded, clusters.missing_counts(rows), threshold, a.prune_factor))
    table = clusters.cluster_table(loaded, found, threshold, min_ratio=a.min_ratio)
    if a.full_output:
        each = F.concat_ws("\t", "id", F.col("degree").cast("string"), F.format_string("%.6f", "rms_d"))
        own = found.groupBy("cluster").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rank", each.alias("t")))), lambda x: x["t"]), "\t"
            ).alias("ids")
        )
        table = table.drop("ids").join(own, "cluster")
    else:
        table = table.withColumn("ids", F.replace("ids", F.lit(","), F.lit("\t")))
    far = table.withColumn("n_far_or_unknown", F.col("n_far") + F.col("n_unknown"))
    sorted_lines(
        far, ["size", "min_d", "avg_d", "max_d", "gap", "n_near", "n_pts_near", "n_far_or_unknown", "min_degree", "ids"],
        ["size", "avg_d", "max_d", F.desc("gap"), "ids"]
    ).write.text(a.output)


def cluster_members(rows: DataFrame) -> DataFrame:
    """(cluster, id, rank) from cluster lines, in the short or the full form."""
    parts = F.split(F.trim("value"), "\t")
    named = rows.filter(~F.startswith("value", F.lit("#"))).select(
        parts[0].try_cast("int").alias("size"), F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0))).alias("t")
    )
    ids = F.when(F.size("t") == 3 * F.col("size"), F.filter("t", lambda x, i: i % 3 == 0)).otherwise(F.col("t"))
    return named.filter("size >= 2").select(ids.alias("ids")).select(
        F.col("ids")[0].alias("cluster"), F.posexplode("ids").alias("rank", "id")
    ).withColumn("rank", F.col("rank") + 1)


def uniquify(spark: SparkSession, a: argparse.Namespace) -> None:
    found = checkpoint(cluster_members(spark.read.text(a.clusters)))
    if a.input:
        g = matrix.read(spark, a.input)
        if a.vote:
            names = g.select("marker", "marker_id", "chrom").distinct()
            out = dedup.voted_genotypes(g, found).join(names, "marker").withColumn("phase", F.lit(None).cast("int"))
        else:
            out = dedup.keep_share(g, found, a.fraction)
        matrix.write(out, a.output)
    if a.pedigrees:
        parts = F.split(F.trim("value"), "\t")
        at = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit("NA"))
        p, f, m = (int(x) for x in a.columns.split(","))
        rows = tables.numbered(spark.read.text(a.pedigrees)).filter(~F.startswith("value", F.lit("#"))).select(
            "line", at(p).alias("prog"), at(f).alias("fpar"), at(m).alias("mpar")
        )
        kept = dedup.unique_pedigrees(rows, found).na.fill("NA", ["fpar", "mpar"])
        sorted_lines(kept, ["prog", "fpar", "mpar"], ["prog"]).write.text(a.pedigrees_output)


def find(spark: SparkSession, a: argparse.Namespace) -> None:
    g = genotypes_of(spark, a)
    if a.thin_marker_fraction < 1:
        g = checkpoint(filters.marker_filter(filters.thin_markers(g, a.thin_marker_fraction, a.seed), 1.0, 0.0))
    records = tables.known_pedigrees(tables.pedigree_records(spark.read.text(a.pedigrees)), g) if a.pedigrees else None
    roles = tables.roles(spark.read.text(a.pob)) if a.pob else candidates.roles_by_heterozygosity(
        g, a.threshold_heterozygosity, a.heterozygosity_range_factor
    ) if a.use_heterozygosity else None
    mean = parents.normalizing_means(g, seed=a.seed) if a.normalize_by_means else {}
    scale = mean.get("hgmr") or 1.0
    out = parents.find_parents(
        g, records, a.alternative_pedigrees_level, roles, a.hgmr_max * scale, a.ftr_max_out * (mean.get("ftr") or 1.0),
        a.d_max * (mean.get("ftr") or 1.0), a.solutions_out, a.candidate_parents_max, not a.unphased
    )
    if mean:
        for c, m in (("hgmr1", "hgmr"), ("hgmr2", "hgmr"), ("r1", "r"), ("r2", "r"), ("ftr", "ftr")):
            out = out.withColumn(c, F.col(c) / (mean[m] or 1.0))
    sorted_lines(out, out.columns, ["prog", F.desc("kind"), "rank"]).write.text(a.output)


CLUSTER_COLUMNS = ["size", "min_d", "avg_d", "max_d", "gap", "n_near", "n_pts_near", "n_far_or_unknown", "min_degree", "ids"]


def write_run(out: dict[str, DataFrame], folder: str) -> None:
    """The tables of a whole run, each in a folder of its own."""
    sorted_lines(out["pairs"], ["q_id", "m_id", "agmr", "hgmr"], ["q_id", "agmr", "m_id"]).write.text(f"{folder}/pairs")
    table = out["clusters"].withColumn(
        "n_far_or_unknown", F.col("n_far") + F.col("n_unknown")
    ).withColumn("ids", F.replace("ids", F.lit(","), F.lit("\t")))
    sorted_lines(table, CLUSTER_COLUMNS, ["size", "avg_d", "max_d", F.desc("gap"), "ids"]).write.text(f"{folder}/clusters")
    sorted_lines(out["histogram"], ["bin", "lo", "n", "cumulative"], ["bin"]).write.text(f"{folder}/histogram")
    if "unique" in out:
        matrix.write(out["unique"], f"{folder}/unique")
    if "parents" in out:
        sorted_lines(out["parents"], out["parents"].columns, ["prog", F.desc("kind"), "rank"]).write.text(f"{folder}/parents")
    if out.get("pedigrees") is not None:
        sorted_lines(out["pedigrees"].na.fill("NA", ["fpar", "mpar"]), ["prog", "fpar", "mpar"], ["prog"]).write.text(f"{folder}/pedigrees")


def parameters(a: argparse.Namespace) -> Parameters:
    threshold = None if a.cluster_distance == "auto" else float(a.cluster_distance)
    given = {n: getattr(a, n) for n in ("vote",) if hasattr(a, n)}
    level = {"level": a.alternative_pedigrees_level} if hasattr(a, "alternative_pedigrees_level") else {}
    return Parameters(
        min_gp=a.prob_min, chunk_size=a.chunk_size, max_marker_missing=a.marker_max_missing_data, max_accession_missing=a.accession_max_missing_data, min_maf=a.maf_min,
        max_distance=a.distance_max, exact=not a.prefilter, threshold=threshold, prune=a.prune_factor, seed=a.seed, **given, **level,
    )


def duplicate_finder(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pairs, clusters and a histogram of the distances, from a VCF or a matrix."""
    write_run(find_duplicates(spark.read.text(a.input), parameters(a)), a.output)


def whole_run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Duplicates are found and reduced, then parents are checked and looked for."""
    records = tables.pedigree_records(spark.read.text(a.pedigrees)) if a.pedigrees else None
    write_run(vcf_to_parents(spark.read.text(a.input), records, parameters(a)), a.output)


def histogram_of(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.text(a.input).filter(~F.startswith("value", F.lit("#")))
    at = lambda i: F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(i)).try_cast("double")
    columns = histogram.column_algebra(a.columns, at)
    values = rows.select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("series"), c.alias("x")) for k, c in enumerate(columns)))).alias("v")
    ).select("v.series", "v.x")
    bins = histogram.auto_bins(values)
    if a.binwidth:
        bins = histogram.Bins(bins.lo, bins.hi, a.binwidth)
    found = histogram.histogram(values, bins.limited(a.lo, a.hi), series="series")
    sorted_lines(found, ["series", "bin", "lo", "n", "cumulative"], ["series", "bin"]).write.text(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="genoquery", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *options, filtered: tuple | None = None):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--input", required=name != "uniquify")
        p.add_argument("--output", required=name != "uniquify")
        p.add_argument("--seed", type=int, default=1)
        if filtered:
            for n, v in zip(
                ("--prob-min", "--marker-max-missing-data", "--accession-max-missing-data", "--maf-min"), filtered, strict=True
            ):
                p.add_argument(n, type=float, default=v)
        for n, kind, default in options:
            p.add_argument(n, action="store_true") if kind is bool else p.add_argument(n, type=kind, default=default)

    command(
        "matrix", to_matrix, ("--rejected", str, None), ("--delta", float, 0.1), ("--alternate-marker-ids", bool, False),
        ("--randomize", bool, False), filtered=(0.9, 1.0, 0.5, 0.0)
    )
    command(
        "duplicates", duplicates, ("--reference", str, None), ("--chunk-size", int, 7), ("--distance-max", float, 0.2),
        ("--passes", int, 1), ("--format", int, 1), ("--prefilter", bool, False), ("--filtered-out", str, None),
        filtered=(0.9, 0.25, 1.0, 0.05)
    )
    command(
        "clusters", cluster, ("--cluster-distance", str, "0.035"), ("--maxd", float, 1.0), ("--pow", float, 1.0),
        ("--min-ratio", float, -1.0), ("--prune-factor", float, 0.2), ("--id1col", int, 1), ("--id2col", int, 3), ("--dcolumn", int, 5),
        ("--full-output", bool, False)
    )
    command(
        "uniquify", uniquify, ("--clusters", str, None), ("--pedigrees", str, None), ("--pedigrees-output", str, None),
        ("--columns", str, "1,2,3"), ("--vote", bool, False), ("--fraction", float, 0.0)
    )
    command(
        "parents", find, ("--pedigrees", str, None), ("--pob", str, None), ("--hgmr-max", float, 0.05), ("--candidate-parents-max", int, 1000), ("--solutions-out", int, 3), ("--ftr-max-out", float, 0.5), ("--d-max", float, 0.025),
        ("--alternative-pedigrees-level", int, 0), ("--unphased", bool, False), ("--normalize-by-means", bool, False), ("--use-heterozygosity", bool, False), ("--threshold-heterozygosity", float, 0.02),
        ("--heterozygosity-range-factor", float, 1.0), ("--thin-marker-fraction", float, 1.0), filtered=(0.9, 0.25, 1.0, 0.05),
    )
    runs = (("--chunk-size", int, 7), ("--distance-max", float, 0.2), ("--prefilter", bool, False), ("--prune-factor", float, 0.2))
    f = FINDER
    command(
        "duplicate-finder", duplicate_finder, *runs[1:], ("--chunk-size", int, f.chunk_size), ("--cluster-distance", str, "auto"),
        filtered=(f.min_gp, f.max_marker_missing, f.max_accession_missing, f.min_maf)
    )
    command(
        "vcf-to-parents", whole_run, *runs, ("--cluster-distance", str, "0.035"), ("--pedigrees", str, None), ("--vote", bool, False),
        ("--alternative-pedigrees-level", int, 0), filtered=(0.9, 0.25, 0.5, 0.05)
    )
    command("histogram", histogram_of, ("--columns", str, "1"), ("--binwidth", float, None), ("--lo", float, None), ("--hi", float, None))
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName(f"genoquery {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
