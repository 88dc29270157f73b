"""Dosage matrices: a MARKER line, an optional CHROMOSOME line, then a line per accession; `#` lines are comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from genoquery.functions.hashing import key as hash_key

SCHEMA = "acc_id string, marker int, marker_id string, chrom int, dosage int, phase int"


def sniff(lines: DataFrame) -> str:
    """Vcf or matrix, by the lines; else an error."""
    if not lines.filter(F.startswith("value", F.lit("#CHROM"))).limit(1).isEmpty():
        return "vcf"
    if not lines.filter(F.startswith("value", F.lit("MARKER"))).limit(1).isEmpty():
        return "matrix"
    raise ValueError("neither a VCF nor a dosage matrix")


def token_dosage(token: Column) -> Column:
    """A whole number from 0 to 2, signed or not; X and numbers beyond are null; anything else is an error."""
    t = F.trim(token)
    number = F.regexp_extract(t, r"^[+-]?(\d+)$", 1)
    value = number.try_cast("int")
    return F.when(F.upper(t).isin("X", "NA"), None).when(
        number == "", F.raise_error(F.concat(F.lit("not a dosage: "), t)).cast("int")
    ).when(value <= 2, value)


def token_phase(token: Column) -> Column:
    return F.when(F.startswith(F.trim(token), F.lit("+")), 1).when(F.startswith(F.trim(token), F.lit("-")), -1)


SMALL_HEADER = 1_000_000


def named(rows: DataFrame, names: DataFrame, on: str, size: int) -> DataFrame:
    """rows with the columns of a header table; up to SMALL_HEADER names (some 20 MB) are broadcast, more are joined by a shuffle."""
    return rows.join(F.broadcast(names) if size <= SMALL_HEADER else names, on)


def parse(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """Rows (acc_id, marker, marker_id, chrom, dosage, phase). A line with another number of tokens than there are markers is an
    error. Without a CHROMOSOME line all chromosomes are 0."""
    real = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    cols = F.split("value", separator)
    rest = real.select(cols[0].alias("acc_id"), F.slice(cols, 2, F.greatest(F.size(cols) - 1, F.lit(0))).alias("t"))
    heads = rest.filter(F.startswith("acc_id", F.lit("MARKER")) | F.startswith("acc_id", F.lit("CHROMOSOME")))
    sizes = {r["acc_id"]: r["n"] for r in heads.groupBy("acc_id").agg(F.max(F.size("t")).alias("n")).collect()}  # two rows
    if "MARKER" not in sizes:
        raise ValueError("no MARKER line")
    n = sizes["MARKER"]
    if sizes.get("CHROMOSOME", n) != n:
        raise ValueError("MARKER and CHROMOSOME lines differ in length")
    head = lambda name: heads.filter(F.col("acc_id") == name).limit(1)
    names = head("MARKER").select(F.posexplode("t").alias("marker", "marker_id"))
    if "CHROMOSOME" in sizes:
        number = F.when(F.col("c").rlike(r"^\d+$"), F.col("c").try_cast("int")).otherwise(0)
        names = names.join(
            head("CHROMOSOME").select(F.posexplode("t").alias("marker", "c")), "marker"
        ).select("marker", "marker_id", number.alias("chrom"))
    else:
        names = names.withColumn("chrom", F.lit(0))
    body = rest.filter(~F.startswith("acc_id", F.lit("MARKER")) & ~F.startswith("acc_id", F.lit("CHROMOSOME")))
    checked = body.withColumn(
        "t",
        F.when(F.size("t") == n, F.col("t")).otherwise(
            F.raise_error(F.concat(F.lit("wrong number of dosages: "), F.col("acc_id"))).cast("array<string>")
        )
    )
    rows = named(checked.select("acc_id", F.posexplode("t").alias("marker", "token")), names, "marker", n)
    dosage = token_dosage(F.col("token"))
    return rows.select(
        "acc_id", "marker", "marker_id", "chrom", dosage.alias("dosage"), F.when(dosage == 1, token_phase(F.col("token"))).alias("phase")
    )


def read(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return parse(spark.read.text(path), separator)


def with_reference(reference: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets with is_ref; different numbers of markers are an error."""
    counts = [df.select("marker").distinct().count() for df in (reference, new)]
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} markers in the reference set, {counts[1]} in the new one")
    return reference.withColumn("is_ref", F.lit(True)).unionByName(new.withColumn("is_ref", F.lit(False)))


def to_lines(genotypes: DataFrame, seed: int | None = None) -> DataFrame:
    """Matrix lines (k, value) in order of k: MARKER, CHROMOSOME, then accessions by id, or in a repeatable random order by
    seed."""
    token = F.expr(
        "case when dosage is null then 'X' when dosage = 1 and phase = 1 then '+1' when dosage = 1 and phase = -1 then '-1' else "
        "cast(dosage as string) end"
    )
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("marker", c))), lambda x: x["v"])
    body = genotypes.groupBy("acc_id").agg(ordered(token.alias("v")).alias("vs"))
    markers = genotypes.select("marker", "marker_id", "chrom").distinct()
    heads = markers.agg(
        ordered(F.col("marker_id").alias("v")).alias("ids"), ordered(F.col("chrom").cast("string").alias("v")).alias("chroms")
    )
    lines = heads.select(
        F.explode(
            F.array(
                F.struct(F.lit("0").alias("k"), F.concat_ws("\t", F.lit("MARKER"), "ids").alias("value")),
                F.struct(F.lit("1").alias("k"), F.concat_ws("\t", F.lit("CHROMOSOME"), "chroms").alias("value"))
            )
        ).alias("x")
    ).select("x.k", "x.value")
    key = F.concat(F.lit("2"), F.col("acc_id")) if seed is None else F.concat(F.lit("2"), hash_key(seed, "acc_id"), F.col("acc_id"))
    return lines.unionByName(body.select(key.alias("k"), F.concat_ws("\t", "acc_id", "vs").alias("value")))


def write(genotypes: DataFrame, path: str, comment: str | None = None) -> None:
    """Text files whose names sort in the order of the lines."""
    lines = to_lines(genotypes)
    if comment:
        lines = lines.unionByName(lines.sparkSession.createDataFrame([("", f"# {comment}")], "k string, value string"))
    lines.orderBy("k").select("value").write.text(path)
