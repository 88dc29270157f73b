"""VCF text to genotypes. Lines are a DataFrame with a column `value`; `read` takes a path, and header and body may be in any number of
files of one set of accessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from genoquery.functions.ratios import tally
from genoquery.sources.matrix import named


@dataclass(frozen=True)
class Options:
    """Delta is how far DS may be from a whole number; min_gp the least best genotype probability (0: no gate); fields in
    order of preference; min_depth for AD; min_gq 0 for no gate."""

    min_gp: float = 0.9
    delta: float = 0.1
    fields: tuple[str, ...] = ("GT", "DS")
    min_depth: int = 5
    min_gq: float = 0.0
    ploidy: int = 2
    chrom_pos_ids: bool = False


def header(lines: DataFrame) -> DataFrame:
    """One row with the fields of the first #CHROM line (c); none without such a line."""
    first = lines.filter(F.startswith("value", F.lit("#CHROM"))).orderBy("value").limit(1)
    return first.select(F.split(F.rtrim(F.col("value")), "\t").alias("c"))


def gt_dosage(gt: Column) -> Column:
    """S3: the sum of the two alleles if both are 0 or 1, whatever the separator; else null."""
    a, b = F.substring(gt, 1, 1), F.substring(gt, 3, 1)
    good = a.isin("0", "1") & b.isin("0", "1") & (F.length(gt) == 3)
    return F.when(good, a.try_cast("int") + b.try_cast("int"))


def gt_phase(gt: Column) -> Column:
    """S3: 1 for 0|1, -1 for 1|0, else null."""
    return F.when(gt == "0|1", 1).when(gt == "1|0", -1)


def ds_dosage(ds: Column, delta: float, ploidy: int = 2) -> Column:
    """The nearest whole number within delta and the ploidy; empty, far or beyond is null."""
    x = F.trim(ds).try_cast("double")
    whole = F.floor(x + 0.5).cast("int")
    return F.when((F.abs(x - whole) <= delta) & (whole >= 0) & (whole <= ploidy), whole)


def ad_dosage(ad: Column, min_depth: int, ploidy: int = 2) -> Column:
    """Ploidy times the alt share of the reads, rounded, from at least min_depth reads."""
    reads = F.transform(F.split(ad, ","), lambda x: x.try_cast("int"))
    ref, alt = F.try_element_at(reads, F.lit(1)), F.try_element_at(reads, F.lit(2))
    return F.when((ref + alt >= min_depth) & (ref + alt > 0), F.floor(ploidy * alt / F.nullif(ref + alt, F.lit(0)) + 0.5).cast("int"))


def gp_good(gp: Column, least: float) -> Column:
    """Three probabilities, one of them at least `least`."""
    parts = F.transform(F.split(gp, ","), lambda x: x.try_cast("double"))
    return (F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull()) & F.exists(parts, lambda x: x >= least)


def chromosome(chrom: Column) -> Column:
    """Its number, with or without `chr` before it; 0 if it has none."""
    return F.coalesce(F.regexp_replace(chrom, "(?i)^chr", "").try_cast("int"), F.lit(0))


def parse(lines: DataFrame, accessions: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """Rows acc_id, marker_id, chrom, pos, dosage, phase. FORMAT is read line by line; the first of the options' fields that it
    has gives the dosage."""
    cols = F.split("value", "\t")
    if accessions is None:
        first = header(lines)
        size = first.select(F.size("c")).first()
        if size is None:
            raise ValueError("no #CHROM line")
        n = max(0, size[0] - 9)
        names = first.select(F.posexplode(F.slice("c", 10, n or 1)).alias("k", "acc_id"))
    else:
        n, names = len(accessions), lines.sparkSession.createDataFrame(list(enumerate(accessions)), "k int, acc_id string")
    body = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(cols.alias("c"))
    marker = F.concat_ws("_", F.col("c")[0], F.col("c")[1]) if options.chrom_pos_ids else F.when(
        (F.col("c")[2] == ".") | (F.col("c")[2] == ""), F.concat_ws("_", F.col("c")[0], F.col("c")[1])
    ).otherwise(F.col("c")[2])
    rows = body.select(
        marker.alias("marker_id"), chromosome(F.col("c")[0]).alias("chrom"), F.col("c")[1].try_cast("bigint").alias("pos"),
        F.split(F.col("c")[8], ":").alias("format"), F.posexplode(F.slice("c", 10, n or 1)).alias("k", "token")
    )
    field = lambda name: F.when(
        F.array_position("format", name) > 0, F.try_element_at(F.split("token", ":"), F.array_position("format", name).cast("int"))
    )
    readers = {
        "GT": lambda f: gt_dosage(f), "DS": lambda f: ds_dosage(f, options.delta, options.ploidy),
        "AD": lambda f: ad_dosage(f, options.min_depth, options.ploidy)
    }
    dosage = F.lit(None).cast("int")
    for name in reversed(options.fields):
        dosage = F.when(F.array_contains("format", name), readers[name](field(name))).otherwise(dosage)
    phase = F.when(F.array_contains("format", "GT"), gt_phase(field("GT")))
    good = F.lit(True)
    if options.min_gp > 0:
        good &= ~F.array_contains("format", "GP") | F.coalesce(gp_good(field("GP"), options.min_gp), F.lit(False))
    if options.min_gq > 0:
        good &= ~F.array_contains("format", "GQ") | F.coalesce(field("GQ").try_cast("double") >= options.min_gq, F.lit(False))
    return named(rows, names, "k", n).select(
        "acc_id", "marker_id", "chrom", "pos", F.when(good, dosage).alias("dosage"), F.when(good & (dosage == 1), phase).alias("phase")
    )


def read(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    return parse(spark.read.text(path), None, options)


def marker_filter(rows: DataFrame, max_missing: float = 1.0, min_maf: float = 0.0) -> DataFrame:
    """Rows of markers whose missing share and minor allele frequency are good."""
    counted = rows.groupBy("marker_id").agg(
        F.count("*").alias("n"), tally("dosage is null").alias("x"), F.coalesce(F.sum("dosage"), F.lit(0)).alias("alt")
    )
    known = 2 * (F.col("n") - F.col("x"))
    good = counted.filter(
        (F.col("x") <= max_missing * F.col("n")) & (F.col("alt") >= min_maf * known) & (F.col("alt") <= (1 - min_maf) * known)
    ).select("marker_id")
    return rows.join(good, "marker_id", "left_semi")


def split_accessions(rows: DataFrame, max_missing: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows of good accessions, rows of rejected ones)."""
    good = rows.groupBy("acc_id").agg(
        F.count("*").alias("n"), tally("dosage is null").alias("x")
    ).filter(F.col("x") <= max_missing * F.col("n")).select("acc_id")
    return rows.join(good, "acc_id", "left_semi"), rows.join(good, "acc_id", "left_anti")


def check_format(lines: DataFrame) -> DataFrame:
    """Per FORMAT and kind of token, how many: ok, colons (other number of fields), GT, DS or GP (bad value)."""
    cols = F.split("value", "\t")
    body = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.col("value"), cols.alias("c"))
    rows = body.select(F.col("c")[8].alias("format"), F.explode(F.slice("c", 10, F.size("c"))).alias("token"))
    names, parts = F.split("format", ":"), F.split("token", ":")
    field = lambda n: F.try_element_at(parts, F.array_position(names, n).cast("int"))
    bad = lambda n, pattern: (F.array_position(names, n) > 0) & ~F.coalesce(
        F.when(F.array_position(names, n) > 0, field(n)).rlike(pattern), F.lit(False)
    )
    kind = F.when(F.size(parts) != F.size(names), "colons").when(bad("GT", r"^[0-9.]([|/][0-9.])+$"), "GT").when(bad("DS", r"^[0-9]*\.?[0-9]+$"), "DS").when(
        bad("GP", r"^[0-9.eE+-]+(,[0-9.eE+-]+)*$"), "GP"
    ).otherwise("ok")
    return rows.groupBy("format", kind.alias("kind")).agg(F.count("*").alias("n"))


def subset(lines: DataFrame, keep: DataFrame) -> DataFrame:
    """VCF lines with the listed accessions' (acc_id) columns only, in the file's order. A line is split once, whatever the number of
    columns; one that ends before the last column kept is an error, an empty one stays."""
    found = header(lines).select(F.posexplode(F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0)))).alias("k", "acc_id"))
    listed = found.join(keep.select("acc_id").distinct().withColumn("kept", F.lit(True)), "acc_id", "left")
    kept = F.transform(
        F.sort_array(F.collect_list(F.struct("k", F.coalesce("kept", F.lit(False)).alias("kept")))), lambda x: x["kept"]
    )
    places = listed.agg(
        F.concat(F.array_repeat(F.lit(True), 9), kept).alias("__kept"), F.coalesce(F.max(F.when(F.col("kept"), F.col("k") + 10)), F.lit(0)).alias("__last")
    )
    cols = F.split("value", "\t")
    each = F.filter(F.arrays_zip(cols.alias("t"), F.col("__kept").alias("kept")), lambda x: x["kept"])
    chosen = F.concat_ws("\t", F.transform(each, lambda x: x["t"]))
    short = F.raise_error(F.concat(F.lit("a line ends before the last accession kept: "), F.substring("value", 1, 80)))
    both = lines.crossJoin(F.broadcast(places))  # one row with a mark for each accession
    value = F.when(F.startswith("value", F.lit("##")) | (F.trim("value") == ""), F.col("value")).when(
        F.size(cols) < F.col("__last"), short
    ).otherwise(chosen)
    return both.withColumn("value", value).drop("__kept", "__last")


def from_genotypes(genotypes: DataFrame) -> DataFrame:
    """VCF lines (GT:GP) of genotypes, for round trips: a line per marker, header lines first when sorted by `k`."""
    gt = F.expr(
        "case when dosage is null then '.|.' when dosage = 0 then '0|0' when dosage = 2 then '1|1' when phase = -1 then '1|0' when "
        "phase = 1 then '0|1' else '0/1' end"
    )
    token = F.concat(
        gt, F.expr("case when dosage = 0 then ':0.98,0.01,0.01' when dosage = 1 then ':0.01,0.98,0.01' else ':0.01,0.01,0.98' end")
    )
    body = genotypes.groupBy("marker", "marker_id", "chrom").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("acc_id", token.alias("t")))), lambda x: x["t"]).alias("ts")
    )
    lines = body.select(
        (F.col("marker") + 2).cast("bigint").alias("k"),
        F.concat_ws(
            "\t", F.concat(F.lit("chr"), F.col("chrom").cast("string")), (100 * (F.col("marker") + 1)).cast("string"), "marker_id",
            F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:GP"), "ts"
        ).alias("value")
    )
    ids = genotypes.select("acc_id").distinct().agg(F.sort_array(F.collect_list("acc_id")).alias("ids"))
    head = ids.select(
        F.lit(1).cast("bigint").alias("k"),
        F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), "ids").alias("value")
    )
    return lines.unionByName(head)
