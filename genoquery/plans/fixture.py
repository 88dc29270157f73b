"""Genotypes from the `embeddings` table: an accession per vector, a marker per dimension, with replicates and offspring.

The rule is the same in Spark and in the SQL of the oracles, and covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RULE = """
base AS (
  SELECT vec_id AS a, CAST(m AS INT) AS m, CAST({div_m16} AS INT) AS chrom,
         CASE WHEN (vec_id*7 + m*13) % 41 = 0 THEN NULL WHEN CAST({item} AS DOUBLE) < -0.06 THEN 0 WHEN CAST({item} AS DOUBLE) < 0.06 THEN 1 ELSE 2 END AS d,
         CASE WHEN (vec_id + {div_m3}) % 2 = 0 THEN 1 ELSE -1 END AS ph
  FROM {source}),
hap AS (
  SELECT a, m, chrom, d, ph,
         CASE d WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN CASE WHEN ph = 1 THEN 0 ELSE 1 END END AS h0,
         CASE d WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN CASE WHEN ph = 1 THEN 1 ELSE 0 END END AS h1
  FROM base),
kid AS (
  SELECT b.a, b.m, b.chrom,
         CASE WHEN (b.chrom + {div_a10} + CASE WHEN b.a % 20 = 8 AND b.m % 16 >= 8 THEN 1 ELSE 0 END) % 2 = 0 THEN p.h0 ELSE p.h1 END AS g1,
         CASE WHEN (CASE WHEN b.a % 10 = 3 THEN {div_c2} ELSE b.chrom END + {div_a10}) % 2 = 0 THEN q.h1 ELSE q.h0 END AS g2
  FROM base b JOIN hap p ON p.a = b.a - 1 AND p.m = b.m
  JOIN hap q ON q.a = CASE WHEN b.a % 10 = 3 THEN b.a - 1 ELSE b.a - 2 END AND q.m = b.m
  WHERE b.a % 10 IN (3, 8)),
geno AS (
  SELECT a, m, chrom, d, CASE WHEN d = 1 THEN ph END AS ph FROM base WHERE a % 10 NOT IN (3, 5, 8)
  UNION ALL
  SELECT b.a, b.m, b.chrom, CASE WHEN (b.a*31 + b.m*17) % 97 = 0 THEN 2 - s.d ELSE s.d END, CASE WHEN s.d = 1 THEN s.ph END
  FROM base b JOIN base s ON s.a = b.a - 1 AND s.m = b.m WHERE b.a % 10 = 5
  UNION ALL
  SELECT a, m, chrom, g1 + g2, CASE WHEN g1 + g2 = 1 THEN CASE WHEN g1 = 0 THEN 1 ELSE -1 END END FROM kid),
g AS (
  SELECT concat('A', lpad(CAST(a AS {text}), 9, '0')) AS acc_id, m AS marker, concat('M', lpad(CAST(m AS {text}), 3, '0')) AS marker_id, chrom + 1 AS chrom,
         CAST(d AS INT) AS dosage, CAST(ph AS INT) AS phase
  FROM geno),
ped AS (
  SELECT concat('A', lpad(CAST(vec_id AS {text}), 9, '0')) AS prog,
         CASE WHEN vec_id % 60 = 38 THEN NULL ELSE concat('A', lpad(CAST(vec_id - 1 AS {text}), 9, '0')) END AS fpar,
         concat('A', lpad(CAST(CASE WHEN vec_id % 10 = 3 THEN vec_id - 1 WHEN vec_id % 30 = 8 THEN vec_id - 3 ELSE vec_id - 2 END AS {text}), 9, '0')) AS mpar
  FROM embeddings WHERE vec_id % 10 IN (3, 8))
"""

_DUCK = dict(
    div_m16="m // 16", div_m3="m // 3", div_a10="b.a // 10", div_c2="b.chrom // 2", item="embedding[m+1]",
    source="embeddings, range(64) t(m)", text="VARCHAR"
)
_SPARK = dict(
    div_m16="m div 16", div_m3="(m div 3)", div_a10="(b.a div 10)", div_c2="(b.chrom div 2)", item="element_at(embedding, m+1)",
    source="embeddings LATERAL VIEW explode(sequence(0, 63)) t AS m", text="STRING"
)

#: The start of an oracle query; it continues with more common tables or SELECT.
PREFIX = "WITH RECURSIVE " + _RULE.format(**_DUCK)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rule = "WITH " + _RULE.format(**_SPARK).replace("FROM embeddings", "FROM {embeddings}")
    return spark.sql(f"{rule} SELECT * FROM {name}", embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acc_id, marker, marker_id, chrom, dosage (null: missing), phase (1, -1 or null)."""
    return _read(spark, sf_dir, "g")


def pedigrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prog, fpar, mpar; a part of the second parents is wrong, a part of the first unknown."""
    return _read(spark, sf_dir, "ped")
