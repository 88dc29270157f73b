"""Pedigree and role files, pair lists, and formats of other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with `line`, which grows in file order (not dense)."""
    return lines.withColumn("line", F.monotonically_increasing_id())


def pedigree_records(lines: DataFrame) -> DataFrame:
    """(line, prog, fpar, mpar) from the first three fields; NA and fewer fields are null. Comments and empty lines are skipped. A `line`
    column is kept, else made."""
    base = lines if "line" in lines.columns else numbered(lines)
    parts = F.split(F.trim("value"), r"\t|\s+")
    at = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit("NA"))
    rows = base.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return rows.select("line", at(1).alias("prog"), at(2).alias("fpar"), at(3).alias("mpar"))


def known_pedigrees(records: DataFrame, accessions: DataFrame) -> DataFrame:
    """Pedigrees of genotyped progeny with a genotyped parent (others are null); of a progeny's records the last."""
    ids = accessions.select("acc_id").distinct()
    rows = records.join(ids.withColumnRenamed("acc_id", "prog"), "prog", "left_semi")
    for c in ("fpar", "mpar"):
        rows = rows.join(
            ids.select(F.col("acc_id").alias(f"__{c}")), F.col(c) == F.col(f"__{c}"), "left"
        ).withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    last = rows.filter("fpar is not null or mpar is not null").groupBy("prog").agg(F.max(F.struct("line", "fpar", "mpar")).alias("x"))
    return last.select("prog", "x.fpar", "x.mpar")


def roles(lines: DataFrame) -> DataFrame:
    """(acc_id, role) with role p, o, b or n; other lines are skipped."""
    parts = F.split("value", "\t")
    return lines.select(
        F.try_element_at(parts, F.lit(1)).alias("acc_id"), F.lower(F.trim(F.try_element_at(parts, F.lit(2)))).alias("role")
    ).filter(F.col("role").isin("p", "o", "b", "n"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """P11's sink: the pair list as lines."""
    text = [F.format_string("%.6f", c) for c in ("agmr", "hgmr")]
    return pairs.select(
        "q_id", "agmr", "m_id",
        F.concat_ws(
            "\t", "q_id", F.col("q_md").cast("string"), "m_id", F.col("m_md").cast("string"), text[0], F.coalesce(text[1], F.lit("-"))
        ).alias("value")
    )


def read_pairs(lines: DataFrame, id1: int = 1, id2: int = 3, d: int = 5) -> DataFrame:
    """(id1, md1, id2, md2, d) from pair lines; ids' missing counts stand after them. Comments are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rows = lines.filter(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    return rows.select(
        at(id1).alias("id1"), at(id1 + 1).try_cast("bigint").alias("md1"), at(id2).alias("id2"),
        at(id2 + 1).try_cast("bigint").alias("md2"), at(d).try_cast("double").alias("d")
    ).filter("d is not null")


def distance_matrix(rows: DataFrame, ids: DataFrame, max_d: float) -> DataFrame:
    """Pairs (id1, id2, d) of a dense matrix (line, values: array of distances), lower triangle, d <= max_d. ids: (line, id)."""
    cells = rows.select("line", F.posexplode("values").alias("col", "d")).filter((F.col("col") < F.col("line")) & (F.col("d") <= max_d))
    return cells.join(ids.select("line", F.col("id").alias("id1")), "line").join(
        ids.select(F.col("line").alias("col"), F.col("id").alias("id2")), "col"
    ).select("id1", "id2", "d")


def to_ped(genotypes: DataFrame) -> DataFrame:
    """PLINK ped lines (acc_id, value): L and H alleles, 0 for missing."""
    pair = F.expr("case dosage when 0 then 'L L' when 1 then 'L H' when 2 then 'H H' else '0 0' end")
    body = genotypes.groupBy("acc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("marker", pair.alias("v")))), lambda x: x["v"]).alias("vs")
    )
    return body.select("acc_id", F.concat_ws(" ", "acc_id", "acc_id", F.lit("0 0 0 -9"), "vs").alias("value"))


def to_map(markers: DataFrame) -> DataFrame:
    """PLINK map rows (chrom, marker_id, cm, pos); chromosome and position come from ids like 3_1234, S3_1234 or chr3:1234."""
    part = lambda i: F.regexp_extract("marker_id", r"(\d+)[_:](\d+)", i)
    return markers.select(
        F.coalesce(part(1).try_cast("int"), F.col("chrom")).alias("chrom"), "marker_id", F.lit(0).alias("cm"),
        F.coalesce(part(2).try_cast("bigint"), F.lit(0)).alias("pos")
    )
