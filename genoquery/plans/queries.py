"""A query per operator over whole tables, and the SQL that gives the same rows.

Queries marked without SQL draw on text order, iteration or densities that SQL doesn't express; tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.functions.masks import pack
from genoquery.operators import candidates as cand, cluster1d, clusters, counts, dedup, filters, histogram, pairs, parents, pedigree_graph as graph, phasing, triples
from genoquery.plans.fixture import PREFIX, genotypes, pedigrees
from genoquery.sources import matrix, tables, vcf

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}
NEAR = 0.2


def entry(name: str, sql: str | None = None, more: str = ""):
    """Register a query; sql continues the fixture's common tables, after `more` of them."""

    def put(f: Query) -> Query:
        ENTRIES[name] = (f, f"{PREFIX}{more}\n{sql}" if sql else None)
        return f

    return put


def one(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row.values())], schema)


def text(df: DataFrame, *columns: str) -> DataFrame:
    """Lines of a table, tab separated; null is NA."""
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns)).alias("value"))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with their place in the output, for a checkpointed table whose partitions are written in order."""
    numbered = rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"))
    before = {r["__part"]: r["n"] for r in numbered.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, total = {}, 0
    for part in sorted(before):
        starts[part], total = total, total + before[part]
    first = F.create_map(*(F.lit(x) for kv in (starts or {0: 0}).items() for x in kv))
    return numbered.withColumn(
        "place", F.col("__id") - F.shiftleft(F.col("__part").cast("bigint"), 33) + first[F.col("__part")]
    ).drop("__part", "__id")


# ---- common tables of the oracles -------------------------------------------------------------------------------------------------

def u(seed: str, *columns: str) -> str:
    """Uniform numbers from md5, as in functions.hashing."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 8) AS BIGINT) / 4294967296.0)"


ACC = """, ac AS (
  SELECT acc_id, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2,
         count(*) FILTER (dosage IS NULL) AS n_missing FROM g GROUP BY acc_id)"""
MARK = """, mc AS (
  SELECT marker, min(marker_id) AS marker_id, min(chrom) AS chrom, count(*) AS n_acc, count(*) FILTER (dosage IS NULL) AS n_missing,
         CAST(coalesce(sum(dosage), 0) AS BIGINT) AS n_alt, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1,
         count(*) FILTER (dosage = 2) AS n2 FROM g GROUP BY marker)"""
SHARE = MARK + """, sh AS (
  SELECT marker, n0 / CAST(n0+n1+n2 AS DOUBLE) AS f0, n1 / CAST(n0+n1+n2 AS DOUBLE) AS f1, n2 / CAST(n0+n1+n2 AS DOUBLE) AS f2,
         n_alt / CAST(2*(n0+n1+n2) AS DOUBLE) AS q, (n0+n1+n2) / CAST(n_acc AS DOUBLE) AS ok FROM mc WHERE n0+n1+n2 > 0)"""
PAIRS = """, gk AS (SELECT acc_id, marker, dosage FROM g WHERE dosage IS NOT NULL), pc AS (
  SELECT x.acc_id AS q_id, y.acc_id AS m_id, count(*) FILTER (abs(x.dosage - y.dosage) = 2) AS n02,
         count(*) FILTER (x.dosage = y.dosage AND x.dosage <> 1) AS n00_22, count(*) FILTER (abs(x.dosage - y.dosage) = 1) AS n01_12,
         count(*) FILTER (x.dosage = 1 AND y.dosage = 1) AS n11
  FROM gk x JOIN gk y ON x.marker = y.marker AND x.acc_id > y.acc_id GROUP BY 1, 2),
pr AS (
  SELECT *, (n02 + n01_12) / CAST(n02 + n00_22 + n01_12 + n11 AS DOUBLE) AS agmr,
         CASE WHEN n02 + n00_22 > 0 THEN n02 / CAST(n02 + n00_22 AS DOUBLE) END AS hgmr FROM pc)"""
MD = ACC + PAIRS
DIST = PAIRS + f", ds AS (SELECT m_id AS a, q_id AS b, agmr AS d FROM pr WHERE agmr <= {NEAR})"
CAND = PAIRS + """, cd AS (
  SELECT q_id AS prog, m_id AS par, n11, hgmr FROM pr WHERE hgmr <= 0.05
  UNION ALL SELECT m_id, q_id, n11, hgmr FROM pr WHERE hgmr <= 0.05)"""
COMPONENTS = """, bw AS (SELECT a, b FROM {e} UNION SELECT b, a FROM {e}), reach AS (
  SELECT a AS id, a AS other FROM bw UNION SELECT r.id, e.b FROM reach r JOIN bw e ON e.a = r.other),
cc AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)"""


def threshold_clusters(threshold: float | str) -> str:
    """Clusters at a threshold, pruned, with degrees and ranks (cl)."""
    return DIST + f""", e0 AS (SELECT a, b, d FROM ds WHERE d <= {threshold}),
s0 AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r0 AS (SELECT a AS id, a AS other FROM s0 UNION SELECT r.id, e.b FROM r0 r
  JOIN s0 e ON e.a = r.other),
c0 AS (SELECT id, min(other) AS cluster FROM r0 GROUP BY id), d0 AS (SELECT a AS id, count(*) AS degree FROM s0 GROUP BY a),
z0 AS (SELECT cluster, count(*) AS size FROM c0 GROUP BY cluster),
weak AS (SELECT c0.id FROM c0 JOIN z0 USING (cluster) JOIN d0 USING (id) WHERE degree < 0.2 * (size - 1)),
e1 AS (SELECT * FROM e0 WHERE a NOT IN (SELECT id FROM weak) AND b NOT IN (SELECT id FROM weak)),
s1 AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1), r1 AS (SELECT a AS id, a AS other FROM s1 UNION SELECT r.id, e.b FROM r1 r
  JOIN s1 e ON e.a = r.other),
c1 AS (SELECT id, min(other) AS cluster FROM r1 GROUP BY id), d1 AS (SELECT a AS id, count(*) AS degree FROM s1 GROUP BY a),
z1 AS (SELECT cluster, count(*) AS size FROM c1 GROUP BY cluster),
mdc AS (SELECT acc_id AS id, count(*) FILTER (dosage IS NULL) AS md FROM g GROUP BY acc_id),
ins AS (SELECT x.cluster, ds.* FROM ds JOIN c1 x ON ds.a = x.id JOIN c1 y ON ds.b = y.id AND x.cluster = y.cluster),
dd AS (SELECT id, sum(d * d) AS dd FROM (SELECT a AS id, d FROM ins UNION ALL SELECT b, d FROM ins) GROUP BY id),
cl AS (SELECT c1.cluster, c1.id, degree, md, round(sqrt(coalesce(dd, 0) / (size - 1)), 9) AS rms_d,
         row_number() OVER (PARTITION BY c1.cluster ORDER BY md, degree DESC, c1.id) AS rank
       FROM c1 JOIN z1 USING (cluster) JOIN d1 USING (id) JOIN mdc USING (id) LEFT JOIN dd USING (id)),
rp AS (SELECT cl.id, r.id AS rep, cl.cluster FROM cl JOIN cl r ON r.cluster = cl.cluster AND r.rank = 1)"""


TRIPLE = """, tk AS (
  SELECT t.prog, t.p1, t.p2, k.marker, i.dosage AS i, j.dosage AS j, k.dosage AS k FROM {t} t
  JOIN g k ON k.acc_id = t.prog LEFT JOIN g i ON i.acc_id = t.p1 AND i.marker = k.marker LEFT JOIN g j ON j.acc_id = t.p2
    AND j.marker = k.marker),
tc AS (SELECT prog, p1, p2,
  count(*) FILTER (i + j + k IS NOT NULL) AS n_good, count(*) FILTER (i <> j AND k IS NOT NULL) AS n_differ,
  count(*) FILTER ((k = 2 AND (i = 0 OR j = 0) OR k = 0 AND (i = 2 OR j = 2)) AND i + j IS NOT NULL) AS n_opp,
  count(*) FILTER (i = j AND i <> 1 AND k = 1) AS n_hh, count(*) FILTER (i = j AND i <> 1 AND abs(i - k) = 2) AS n_ho,
  count(*) FILTER (i = j AND i <> 1 AND k IS NOT NULL) AS n_hom, count(*) FILTER (i = 1 AND j = 1 AND k IS NOT NULL) AS n_11,
  count(*) FILTER (i = 1 AND j = 1 AND k = 1) AS n_111, count(*) FILTER ((i = 1 OR j = 1) AND i + j + k IS NOT NULL) AS n_het,
  count(*) FILTER ((i = 1 OR j = 1) AND i + j IS NOT NULL AND k = 1) AS n_het1,
  count(*) FILTER (abs(i - k) = 2) AS m1, count(*) FILTER (i = k AND i <> 1) AS s1, count(*) FILTER (i <> 1 AND k = 1) AS h1,
  count(*) FILTER (abs(j - k) = 2) AS m2, count(*) FILTER (j = k AND j <> 1) AS s2, count(*) FILTER (j <> 1 AND k = 1) AS h2
  FROM tk GROUP BY prog, p1, p2),
ts AS (SELECT prog, p1, p2,
  CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN n_good END AS n_good,
  CASE WHEN n_good > 0 THEN n_differ / CAST(n_good AS DOUBLE) END AS agmr12,
  CASE WHEN m1 + s1 > 0 THEN m1 / CAST(m1 + s1 AS DOUBLE) END AS hgmr1,
  CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN CASE WHEN h1 + s1 > 0 THEN h1 / CAST(h1 + s1 AS DOUBLE) END
       WHEN m1 + h1 + s1 > 0 THEN (m1 + h1) / CAST(m1 + h1 + s1 AS DOUBLE) END AS r1,
  CASE WHEN m2 + s2 > 0 THEN m2 / CAST(m2 + s2 AS DOUBLE) END AS hgmr2,
  CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN CASE WHEN h2 + s2 > 0 THEN h2 / CAST(h2 + s2 AS DOUBLE) END
       WHEN m2 + h2 + s2 > 0 THEN (m2 + h2) / CAST(m2 + h2 + s2 AS DOUBLE) END AS r2,
  CASE WHEN n_good > 0 THEN (n_opp + n_hh + n_ho) / CAST(n_good AS DOUBLE) END AS ftr,
  CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN n_opp + n_hh + n_ho END AS ftr_n,
  CASE WHEN n_hom > 0 THEN n_hh / CAST(n_hom AS DOUBLE) END AS z, CASE WHEN n_11 > 0 THEN n_111 / CAST(n_11 AS DOUBLE) END AS h,
  CASE WHEN n_het > 0 THEN n_het1 / CAST(n_het AS DOUBLE) END AS hhr FROM tc)"""
PEDT = ", pt AS (SELECT prog, fpar AS p1, mpar AS p2 FROM ped)"
PAIRT = ", pp AS (SELECT prog, fpar AS par FROM ped WHERE fpar IS NOT NULL UNION SELECT prog, mpar FROM ped)"
CROSS = """, xm AS (
  SELECT t.prog, t.par, p.chrom, p.marker, k.dosage AS k, k.phase AS kp, p.phase AS ph FROM {t} t
  JOIN g p ON p.acc_id = t.par AND p.dosage = 1 AND p.phase IS NOT NULL JOIN g k ON k.acc_id = t.prog AND k.marker = p.marker
    AND k.dosage IS NOT NULL),
xs AS (SELECT *, ((k = 2) <> (ph = -1)) AS side FROM xm WHERE k <> 1),
xl AS (SELECT *, lag(side) OVER (PARTITION BY prog, par, chrom ORDER BY marker) AS before FROM xs),
xx AS (SELECT prog, par, count(*) FILTER (side <> before) AS x, count(*) AS n_het FROM xl GROUP BY prog, par)"""
ALT = CAND + """, rk AS (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY hgmr, par) AS rank FROM cd),
q1 AS (SELECT a.prog, a.par AS p1, b.par AS p2 FROM rk a JOIN rk b ON a.prog = b.prog AND a.rank <= b.rank WHERE a.rank <= 1000 AND b.rank <= 1000)"""
BEST = ALT + TRIPLE.format(t="q1") + """, bs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY ftr, p1, p2) AS rank FROM ts WHERE ftr <= 0.5) WHERE rank <= 3)"""


# ---- filters ----------------------------------------------------------------------------------------------------------------------

ROWS = "acc_id, marker, dosage"


@entry(
    "f1_accession_filter",
    "SELECT acc_id, marker, dosage FROM g WHERE acc_id IN (SELECT acc_id FROM g GROUP BY acc_id HAVING "
    "count(*) FILTER (dosage IS NULL) <= 0.03 * count(*))"
)
def _(spark, d):
    return filters.accession_filter(genotypes(spark, d), 0.03).select("acc_id", "marker", "dosage")


@entry("f1_rejected_accessions", "SELECT acc_id, n_missing FROM ac WHERE n_missing > 0.03 * 64", ACC)
def _(spark, d):
    return filters.rejected_accessions(genotypes(spark, d), 0.03).groupBy("acc_id").agg(
        F.count_if(F.col("dosage").isNull()).alias("n_missing")
    )


F2_SQL = ", ok AS (SELECT marker, row_number() OVER (ORDER BY marker) - 1 AS place FROM mc WHERE n_missing <= 0.027 * n_acc AND n_alt >= 2 * (n_acc - n_missing) * 0.47 AND n_alt <= 2 * (n_acc - n_missing) * (1 - 0.47))"


@entry("f2_marker_filter", "SELECT acc_id, CAST(place AS INT) AS marker, marker_id, dosage FROM g JOIN ok USING (marker)", MARK + F2_SQL)
def _(spark, d):
    return filters.marker_filter(genotypes(spark, d), 0.027, 0.47).select("acc_id", "marker", "marker_id", "dosage")


@entry("f3_auto_threshold", "SELECT 1.5 * quantile_disc(n_missing / CAST(n_acc AS DOUBLE), 0.5) AS threshold FROM mc", MARK)
def _(spark, d):
    return one(spark, {"t": filters.missing_threshold(genotypes(spark, d), -1.5)}, "threshold double")


@entry("f4_thin_markers", f"SELECT acc_id, marker, dosage FROM g WHERE {u('1', 'marker_id')} < 0.4")
def _(spark, d):
    return filters.thin_markers(genotypes(spark, d), 0.4).select("acc_id", "marker", "dosage")


@entry(
    "f5_rectify_markers",
    "SELECT acc_id, g.marker, CASE WHEN n_alt > g2.n_acc - g2.n_missing THEN 2 - dosage ELSE dosage END AS dosage, CASE "
    "WHEN n_alt > g2.n_acc - g2.n_missing THEN -phase ELSE phase END AS phase FROM g JOIN mc g2 ON g.marker = g2.marker",
    MARK
)
def _(spark, d):
    return filters.rectify_markers(genotypes(spark, d)).select("acc_id", "marker", "dosage", "phase")


@entry(
    "f6_check_counts",
    "SELECT count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2, "
    "count(*) FILTER (dosage IS NULL) AS nx, true AS consistent FROM g"
)
def _(spark, d):
    return filters.check_counts(genotypes(spark, d))


@entry("f7_select_columns", "SELECT mpar, prog FROM ped")
def _(spark, d):
    return filters.select_columns(pedigrees(spark, d), [-1, 1])


LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


# the first column and those whose crc32 of "1:name" is below 0.3 * 2**32, worked out by hand
@entry("f8_sample_columns", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(spark, d):
    return filters.sample_columns(spark.read.parquet(f"{d}/lineitem.parquet"), 0.3)


@entry("f9_select_accessions", "SELECT acc_id, marker, dosage FROM g WHERE acc_id IN (SELECT mpar FROM ped)")
def _(spark, d):
    return filters.select_accessions(
        genotypes(spark, d), pedigrees(spark, d).select(F.col("mpar").alias("acc_id"))
    ).select("acc_id", "marker", "dosage")


@entry(
    "f10_quadrants",
    "SELECT quadrant, count(*) AS n FROM (SELECT CASE WHEN hgmr IS NULL THEN 'nan' ELSE (CASE WHEN hgmr <= 0.05 THEN 'L' ELSE 'U' "
    "END) || (CASE WHEN agmr <= 0.2 THEN 'L' ELSE 'R' END) END AS quadrant FROM pr) GROUP BY quadrant",
    PAIRS
)
def _(spark, d):
    return filters.quadrants(
        pairs.similar_pairs(genotypes(spark, d), 1.0), "agmr", "hgmr", 0.2, 0.05
    ).groupBy("quadrant").agg(F.count("*").alias("n"))


@entry(
    "f11_distinct_ids",
    "SELECT CASE WHEN k > 1 THEN mpar || '__' || k ELSE mpar END AS mpar, prog FROM (SELECT *, row_number() "
    "OVER (PARTITION BY mpar ORDER BY prog) AS k FROM ped)"
)
def _(spark, d):
    return filters.distinct_ids(pedigrees(spark, d), "mpar", "prog").select("mpar", "prog")


@entry("f12_high_missing_rows", "SELECT acc_id FROM ac WHERE n_missing <= 0.5 * 64", ACC)
def _(spark, d):
    return filters.accession_filter(genotypes(spark, d), 0.5).select("acc_id").distinct()


@entry("f13_sorted_numbers", "SELECT x FROM (SELECT try_cast(o_totalprice AS DOUBLE) AS x FROM orders) WHERE x IS NOT NULL")
def _(spark, d):
    lines = text(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey", "o_totalprice")
    return filters.sorted_numbers(lines, 2)


# ---- counts -----------------------------------------------------------------------------------------------------------------------

@entry("a1_accession_counts", "SELECT *, CASE WHEN n0+n1+n2 > 0 THEN n1 / CAST(n0+n1+n2 AS DOUBLE) END AS heterozygosity FROM ac", ACC)
def _(spark, d):
    return counts.accession_counts(genotypes(spark, d))


@entry("a2_marker_counts", "SELECT * FROM mc", MARK)
def _(spark, d):
    return filters.marker_counts(genotypes(spark, d))


@entry(
    "a2_grand_totals",
    "SELECT chrom, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2, "
    "count(*) FILTER (dosage IS NULL) AS nx FROM g GROUP BY ROLLUP (chrom)"
)
def _(spark, d):
    return counts.grand_totals(genotypes(spark, d))


@entry(
    "a5_phase_counts",
    "SELECT acc_id, count(*) FILTER (dosage = 1 AND phase IS NOT NULL) AS het_phased, count(*) FILTER (dosage = 1 "
    "AND phase IS NULL) AS het_unphased, count(*) FILTER (dosage IN (0, 2) AND phase IS NOT NULL) AS hom_phased FROM g "
    "GROUP BY acc_id"
)
def _(spark, d):
    return counts.phase_counts(genotypes(spark, d))


@entry("a6_matrix_info", """SELECT count(DISTINCT acc_id) AS n_acc, CAST(0 AS BIGINT) AS n_all_missing,
  count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1 AND phase = -1) AS n1m,
  count(*) FILTER (dosage = 1 AND coalesce(phase, 1) = 1) AS n1p, count(*) FILTER (dosage = 2) AS n2,
    count(*) FILTER (dosage IS NULL) AS nx,
  count(*) FILTER (dosage = 1) / CAST(count(dosage) AS DOUBLE) AS heterozygosity, count(*) FILTER (dosage IS NULL) / CAST(count(*) AS DOUBLE) AS missing_fraction FROM g""")
def _(spark, d):
    return counts.matrix_info(genotypes(spark, d))


@entry("a7_expected_agmr", "SELECT round(sum(2 * (f0 * (f1 + f2) + f1 * f2) * ok * ok) / sum(ok * ok), 9) AS agmr0 FROM sh", SHARE)
def _(spark, d):
    return counts.expected_agmr(genotypes(spark, d))


@entry("a8_a9_expected_by_accession", """SELECT acc_id, round(avg(CASE dosage WHEN 0 THEN f1 + f2 WHEN 1 THEN f0 + f2
  ELSE f0 + f1 END), 9) AS expected_agmr,
  round(sum(CASE WHEN dosage = 1 THEN f0 * f0 + f2 * f2 ELSE 0 END), 6) AS expected_hom_1, round(sum(CASE
    WHEN dosage = 1 THEN f0 + f2 ELSE 0 END), 6) AS expected_self_1
  FROM g JOIN sh USING (marker) WHERE dosage IS NOT NULL GROUP BY acc_id""", SHARE)
def _(spark, d):
    return counts.expected_agmr_by_accession(genotypes(spark, d))


@entry("a9b_expected_of_margins", """SELECT acc_id, round(1 - CAST(n0*t0 + n1*t1 + n2*t2 AS DOUBLE) / ((n0+n1+n2) * (t0+t1+t2)),
  9) AS expected_agmr FROM ac,
  (SELECT CAST(sum(n0) AS BIGINT) AS t0, CAST(sum(n1) AS BIGINT) AS t1, CAST(sum(n2) AS BIGINT) AS t2 FROM ac)""", ACC)
def _(spark, d):
    return counts.expected_agmr_of_margins(genotypes(spark, d))


def orders_lines(spark, d):
    return text(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey", "o_totalprice", "o_custkey")


@entry("a10_histogram", """SELECT series, CAST(bin AS INT) AS bin, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY series
  ORDER BY bin) AS BIGINT) AS cumulative, round(0.0 + bin * 0.25, 9) AS lo FROM (
  SELECT series, CASE WHEN x < 0 THEN -1 WHEN x >= 6 THEN 24 ELSE floor(x / 0.25) END AS bin FROM (
    SELECT 'log' AS series, log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0 UNION ALL SELECT 'ratio', o_totalprice / nullif(CAST(o_custkey AS DOUBLE), 0) FROM orders) WHERE x IS NOT NULL) GROUP BY series, bin""")
def _(spark, d):
    lines = orders_lines(spark, d)
    at = lambda i: F.try_element_at(F.split("value", "\t"), F.lit(i)).try_cast("double")
    both = [
        lines.select(F.lit(n).alias("series"), histogram.column_algebra(spec, at)[0].alias("x")) for n,
        spec in (("log", "log2"), ("ratio", "2/3"))
    ]
    return histogram.histogram(both[0].unionByName(both[1]), histogram.Bins(0.0, 6.0, 0.25), series="series")


@entry("a11_auto_bins", f"""SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumulative, round(lo + bin * width, 9) AS lo FROM (
  SELECT CAST(floor((o_totalprice - lo) / width) AS INT) AS bin, count(*) AS n, min(lo) AS lo, min(width) AS width FROM orders, hb GROUP BY 1)""",
       f""", hs AS (SELECT quantile_cont(o_totalprice, 0.05) AS p1, quantile_cont(o_totalprice, 0.95) AS p2, count(*) AS n,
         min(o_totalprice) AS mn FROM orders),
hw AS (SELECT max(c * power(10.0, k)) AS width FROM hs, (SELECT unnest({list(histogram.WIDTHS)}) AS c), range(-8, 10) t(k)
  WHERE c * power(10.0, k) <= (p2 - p1) / 2 / power(n, 1 / 3.0) * (1 + 1e-12)),
hb AS (SELECT width, width * floor(mn / width) AS lo FROM hs, hw)""")
def _(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").cast("double").alias("x"))
    return histogram.histogram(x, histogram.auto_bins(x))


EDITED = histogram.Bins(0.0, 400_000.0, 1000.0).notched(3).expanded(1.1).limited(lo=0.0)


# by hand: 1000 three notches up is 2500; 0..400000 stretched by 1.1 is -20000..420000 in whole bins; cut at 0 leaves 168 bins
@entry("a12_bin_edits", """SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumulative, CAST(bin * 2500 AS DOUBLE) AS lo FROM (
  SELECT CAST(CASE WHEN x < 0 THEN -1 WHEN x >= 420000 THEN 168 ELSE floor(x / 2500) END AS INT) AS bin, count(*) AS n FROM (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders) GROUP BY 1)""")
def _(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").cast("double").alias("x"))
    return histogram.histogram(x, EDITED)


@entry("a13_summary", """SELECT CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS series, count(*) AS n,
  round(avg(CAST(l_extendedprice AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(l_extendedprice AS DOUBLE)), 6) AS sd,
  round(stddev_pop(CAST(l_extendedprice AS DOUBLE)) / sqrt(count(*)), 6) AS se, round(median(CAST(l_extendedprice AS DOUBLE)), 6) AS median FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("series"), F.col("l_extendedprice").cast("double").alias("x")
    )
    return histogram.summary(rows, series="series")


@entry(
    "a14_fields_per_line",
    """SELECT CAST(CASE WHEN coalesce(trim(text), '') = '' THEN 0 ELSE len(string_split(trim(text), ' ')) END AS INT) AS fields, count(*) AS n, min(text) AS sample FROM documents GROUP BY 1"""
)
def _(spark, d):
    return histogram.fields_per_line(
        spark.read.parquet(f"{d}/documents.parquet").select(F.col("text").alias("value")), " "
    )


@entry("a15_compare_sets", """SELECT count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL)
  AS both, count(*) FILTER (l IS NULL) AS right_only
  FROM (SELECT DISTINCT fpar AS l FROM ped WHERE fpar IS NOT NULL) FULL JOIN (SELECT DISTINCT mpar AS r FROM ped) ON l = r""")
def _(spark, d):
    p = pedigrees(spark, d)
    return histogram.compare_sets(p.filter("fpar is not null").select(F.col("fpar").alias("value")), p.select(F.col("mpar").alias("value")))


@entry(
    "a16_compare_pairs",
    "SELECT m_id AS a, q_id AS b, CASE WHEN agmr <= 0.2 THEN agmr END AS d1, CASE WHEN hgmr <= 0.02 THEN hgmr END AS d2 FROM pr "
    "WHERE agmr <= 0.2 OR hgmr <= 0.02",
    PAIRS
)
def _(spark, d):
    g = genotypes(spark, d)
    side = lambda df, c: df.select(F.col("q_id").alias("id1"), F.col("m_id").alias("id2"), F.col(c).alias("d"))
    return histogram.compare_pairs(side(pairs.similar_pairs(g, 0.2), "agmr"), side(pairs.related_pairs(g, 0.02), "hgmr"))


@entry(
    "a17_nearest",
    "SELECT id1, min(agmr) AS d, arg_min(id2, (agmr, id2)) AS id2 FROM (SELECT q_id AS id1, m_id AS id2, agmr FROM pr "
    "WHERE agmr <= 0.5) GROUP BY id1",
    PAIRS
)
def _(spark, d):
    return histogram.nearest(
        pairs.similar_pairs(genotypes(spark, d), 0.5).select(
            F.col("q_id").alias("id1"), F.col("m_id").alias("id2"), F.col("agmr").alias("d")
        )
    )


@entry(
    "a18_error_curve",
    "SELECT o_totalprice, CAST(sum(f) OVER w AS BIGINT) AS n_null, CAST(sum(t) OVER w AS BIGINT) AS n_other "
    "FROM (SELECT o_totalprice, count(*) FILTER (o_custkey % 2 = 0) AS f, count(*) FILTER (o_custkey % 2 <> 0) AS t FROM orders "
    "GROUP BY 1) WINDOW w AS (ORDER BY o_totalprice DESC ROWS UNBOUNDED PRECEDING)"
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("null_id", F.col("o_custkey") % 2 == 0)
    return histogram.error_curve(rows, "o_totalprice", "null_id", "o_orderkey")


# ---- pairs ------------------------------------------------------------------------------------------------------------------------

PAIR_SQL = "SELECT q_id, x.n_missing AS q_md, m_id, y.n_missing AS m_md, n02, n00_22, n01_12, n11, agmr, hgmr FROM pr JOIN ac x ON x.acc_id = q_id JOIN ac y ON y.acc_id = m_id"


@entry("p_pairs", f"{PAIR_SQL} WHERE agmr <= {NEAR}", MD)
def _(spark, d):
    return pairs.ordered(pairs.similar_pairs(genotypes(spark, d), NEAR))


@entry(
    "p11_order", f"""SELECT q_id, m_id, row_number() OVER (ORDER BY q_id, agmr, m_id) - 1 AS place FROM pr WHERE agmr <= {NEAR}""", PAIRS
)
def _(spark, d):
    # the place of each row as the sorted output has it: partitions of a sort are in order, and so are the rows in them
    rows = checkpoint(pairs.ordered(pairs.similar_pairs(genotypes(spark, d), NEAR)), wide=True)
    return in_order(rows.select("q_id", "m_id"))


@entry("p_reference_pairs", f"""SELECT CASE WHEN rq AND NOT rm THEN m_id ELSE q_id END AS q_id, CASE WHEN rq AND NOT rm THEN q_id
  ELSE m_id END AS m_id, agmr FROM (
  SELECT *, q_id IN (SELECT mpar FROM ped) AS rq, m_id IN (SELECT mpar FROM ped) AS rm FROM pr WHERE agmr <= 0.5) WHERE NOT (rq AND rm)""", PAIRS)
def _(spark, d):
    g, p = genotypes(spark, d), pedigrees(spark, d).select(F.col("mpar").alias("acc_id")).distinct()
    both = matrix.with_reference(g.join(p, "acc_id", "left_semi"), g.join(p, "acc_id", "left_anti"))
    return pairs.similar_pairs(both, 0.5).select("q_id", "m_id", "agmr")


CHUNKS = """, od AS (SELECT marker, row_number() OVER (ORDER BY md5(concat_ws(':', '1', marker_id)), marker_id) - 1 AS place
  FROM (SELECT DISTINCT marker, marker_id FROM g)),
cp AS (SELECT acc_id, CAST(place // 4 AS INT) AS chunk, CASE WHEN count(*) = count(dosage) THEN CAST(sum(dosage * CAST(power(3,
  place % 4) AS BIGINT)) AS BIGINT) END AS pattern
  FROM g JOIN od USING (marker) WHERE place < 64 GROUP BY 1, 2),
cm AS (SELECT x.acc_id AS q_id, y.acc_id AS m_id, count(*) AS matches FROM cp x JOIN cp y ON x.chunk = y.chunk
  AND x.pattern = y.pattern AND x.acc_id > y.acc_id GROUP BY 1, 2),
co AS (SELECT acc_id, count(pattern) AS ok FROM cp GROUP BY acc_id),
es AS (SELECT q_id, m_id, matches, CAST(x.ok * y.ok AS DOUBLE) / 16 AS usable FROM cm JOIN co x ON x.acc_id = q_id JOIN co y ON y.acc_id = m_id)"""


@entry("p1_p2_chunk_patterns", "SELECT acc_id, chunk, pattern FROM cp", CHUNKS)
def _(spark, d):
    return pairs.chunk_patterns(genotypes(spark, d), 4)


@entry("p3_p4_chunk_matches", "SELECT q_id, m_id, matches FROM cm", CHUNKS)
def _(spark, d):
    return pairs.chunk_matches(checkpoint(pairs.chunk_patterns(genotypes(spark, d), 4)))


@entry(
    "p5_p9_estimated_pairs",
    "SELECT q_id, m_id, matches, usable, greatest(0.0, round(1 - power(matches / usable, 0.25), 6)) AS est_agmr FROM es "
    "WHERE matches >= power(0.8, 4) * usable",
    CHUNKS
)
def _(spark, d):
    return pairs.estimated_pairs(genotypes(spark, d), NEAR, 4)


@entry(
    "p6_filtered_pairs",
    f"SELECT es.q_id, es.m_id, matches, n02, n00_22, n01_12, n11, agmr FROM es JOIN pr ON es.q_id = pr.q_id AND es.m_id = pr.m_id "
    f"WHERE matches >= power(0.8, 4) * usable AND agmr <= {NEAR}",
    CHUNKS + PAIRS
)
def _(spark, d):
    return pairs.filtered_pairs(genotypes(spark, d), NEAR, 4).select("q_id", "m_id", "matches", "n02", "n00_22", "n01_12", "n11", "agmr")


@entry("p12_all_estimates", "SELECT q_id, m_id, greatest(0.0, round(1 - power(matches / usable, 0.25), 6)) AS est_agmr FROM es", CHUNKS)
def _(spark, d):
    return pairs.estimated_pairs(genotypes(spark, d), 1.0, 4, prefilter=False).select("q_id", "m_id", "est_agmr")


@entry("p13_all_distances", "SELECT count(*) AS n, round(sum(agmr), 6) AS total FROM pr", PAIRS)
def _(spark, d):
    return pairs.distance_counts(genotypes(spark, d)).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("x") * F.col("n")), 6).alias("total"))


@entry("p14_chunk_statistics", """SELECT chunk, n * (n - 1) // 2 AS possible, n * (n - 1) // 2 - ok * (ok - 1) // 2 AS lost,
  CAST(coalesce(m, 0) AS BIGINT) AS matching FROM (SELECT chunk, count(*) AS n, count(pattern) AS ok FROM cp GROUP BY chunk)
  LEFT JOIN (SELECT chunk, sum(k * (k - 1) // 2) AS m FROM (SELECT chunk, pattern, count(*) AS k FROM cp WHERE pattern IS NOT NULL GROUP BY 1, 2) GROUP BY chunk) USING (chunk)""", CHUNKS)
def _(spark, d):
    return pairs.chunk_statistics(checkpoint(pairs.chunk_patterns(genotypes(spark, d), 4)))


@entry("p15_phase_switches", """SELECT q_id, m_id, count(*) FILTER (agree <> before) AS switches, count(before) AS chances,
  count(*) FILTER (agree) AS n_agree FROM (
  SELECT pr.q_id, pr.m_id, x.phase = y.phase AS agree, lag(x.phase = y.phase) OVER (PARTITION BY pr.q_id, pr.m_id, x.chrom
    ORDER BY x.marker) AS before
  FROM pr JOIN g x ON x.acc_id = q_id AND x.phase IS NOT NULL JOIN g y ON y.acc_id = m_id AND y.marker = x.marker AND y.phase IS NOT NULL WHERE agmr <= 0.5) GROUP BY 1, 2""", PAIRS)
def _(spark, d):
    return pairs.similar_phase_switches(genotypes(spark, d), 0.5)


RANKED = ", vr AS (SELECT agmr AS x, row_number() OVER (ORDER BY agmr) - 1 AS k, count(*) OVER () AS n FROM pr)"
#: The boundary of the cluster at the left: qualities of sizes (kq), the best (bq), those of 2 or more (gq) and the best window's end (tq).
LEFT = PAIRS + RANKED + """, sz AS (SELECT i FROM (SELECT unnest(generate_series(8, n // 4 - 1)) AS i, n FROM (SELECT max(n) AS n
  FROM vr)) WHERE 80 * i < 17 * n),
rk AS (SELECT i, 'q1' AS w, unnest([i - 1, i]) AS k FROM sz UNION ALL SELECT i, 'q3', unnest([3 * i - 1, 3 * i]) FROM sz
  UNION ALL SELECT i, 'h', unnest([4 * i - 1, 4 * i]) FROM sz
  UNION ALL SELECT i, 'v1', unnest(CASE WHEN i % 2 = 0 THEN [7 * i // 2 - 1, 7 * i // 2] ELSE [(7 * i - 1) // 2] END) FROM sz
  UNION ALL SELECT i, 'v2', unnest(CASE WHEN i % 2 = 0 THEN [9 * i // 2 - 1, 9 * i // 2] ELSE [(9 * i - 1) // 2] END) FROM sz),
qy AS (SELECT i, avg(x) FILTER (w = 'q1') AS q1, avg(x) FILTER (w = 'q3') AS q3, avg(x) FILTER (w = 'h') AS h,
  avg(x) FILTER (w = 'v1') AS v1, avg(x) FILTER (w = 'v2') AS v2 FROM rk JOIN vr USING (k) GROUP BY i),
qs AS (SELECT i, h, CAST(2 * greatest(v2 - v1, 0) / greatest(q3 - q1, 1e-9) AS DECIMAL(28, 6)) AS q FROM qy),
ps AS (SELECT min(i) AS s FROM qs WHERE q >= 3), pe AS (SELECT min(i) AS e FROM qs, ps WHERE q < 2 AND i > s), pp2
  AS (SELECT min(i) AS p FROM qs, pe WHERE q < 2 AND i > 1.5 * e),
kq AS (SELECT qs.* FROM qs, pp2 WHERE p IS NULL OR i <= p), bq AS (SELECT * FROM kq ORDER BY q DESC, i LIMIT 1), gq AS (SELECT *,
  row_number() OVER (ORDER BY i) AS place FROM kq WHERE q >= 2),
tq AS (SELECT * FROM (SELECT place, sum(q) OVER (ORDER BY place ROWS 32 PRECEDING) AS s FROM gq) WHERE place >= 34 ORDER BY s DESC, place LIMIT 1)"""


# ---- clusters and duplicates ------------------------------------------------------------------------------------------------------

def distances(spark, d) -> DataFrame:
    return pairs.similar_pairs(genotypes(spark, d), NEAR).select(
        F.col("q_id").alias("id1"), F.col("q_md").alias("md1"), F.col("m_id").alias("id2"), F.col("m_md").alias("md2"),
        F.col("agmr").alias("d")
    )


def found_clusters(spark, d, threshold: float):
    rows = checkpoint(distances(spark, d))
    loaded = clusters.load_pairs(rows)
    return loaded, checkpoint(clusters.members(loaded, clusters.missing_counts(rows), threshold))


@entry("c1_load_pairs", "SELECT a, b, d FROM ds", DIST)
def _(spark, d):
    rows = distances(spark, d)
    back = rows.select(
        F.col("id2").alias("id1"), F.col("md2").alias("md1"), F.col("id1").alias("id2"), F.col("md1").alias("md2"),
        (F.col("d") + 0.01).alias("d")
    )
    return clusters.load_pairs(rows.unionByName(back))


@entry("c2_auto_threshold", "SELECT round(coalesce((SELECT h FROM gq, tq WHERE gq.place = tq.place - 16), h), 9) AS t FROM bq", LEFT)
def _(spark, d):
    x = pairs.distance_counts(genotypes(spark, d))
    return one(spark, {"t": cluster1d.auto_threshold(x)}, "t double").select(F.round("t", 9).alias("t"))


@entry("c3_c4_components", "SELECT id, cluster FROM cc", DIST + COMPONENTS.format(e="ds"))
def _(spark, d):
    return clusters.components(clusters.link(clusters.load_pairs(distances(spark, d)), NEAR))


@entry("c5_pruned_edges", "SELECT a, b, d FROM e1", threshold_clusters(NEAR))
def _(spark, d):
    return clusters.prune(clusters.link(clusters.load_pairs(distances(spark, d)), NEAR))


for _name, _threshold in (("c9_members", 0.035), ("c9_members_wide", NEAR)):

    @entry(_name, "SELECT cluster, id, degree, md, rms_d, CAST(rank AS INT) AS rank FROM cl", threshold_clusters(_threshold))
    def _(spark, d, threshold=_threshold):
        return found_clusters(spark, d, threshold)[1]


def cluster_sql(threshold: float | str) -> str:
    return f"""SELECT cluster, size, min_d, round(avg_d, 9) AS avg_d, max_d, gap, n_near, n_pts_near, n_far,
      size * (size - 1) // 2 - n_known AS n_unknown, min_degree, ids FROM (
      SELECT cluster, count(*) AS size, min(degree) AS min_degree, string_agg(id, ',' ORDER BY rank) AS ids FROM cl GROUP BY cluster)
      JOIN (SELECT cluster, min(d) AS min_d, avg(d) AS avg_d, max(d) AS max_d, count(*) FILTER (d > {threshold}) AS n_far,
        count(*) AS n_known FROM ins GROUP BY cluster) USING (cluster)
      JOIN (SELECT c.cluster, coalesce(min(o.d), 100.0) AS gap, count(DISTINCT CASE WHEN o.d < 1.2 * {threshold} THEN o.b END)
        AS n_near, count(DISTINCT CASE WHEN o.d < 1.2 * {threshold} THEN o.a END) AS n_pts_near
        FROM c1 c LEFT JOIN (SELECT s.a, s.b, s.d, y.cluster AS oc FROM (SELECT a, b, d FROM ds UNION ALL SELECT b, a, d
          FROM ds) s LEFT JOIN c1 y ON y.id = s.b) o
        ON o.a = c.id AND (o.oc IS NULL OR o.oc <> c.cluster) GROUP BY c.cluster) USING (cluster)"""


for _name, _threshold in (("c6_c7_c8_cluster_table", 0.035), ("c10_ordered_wide", NEAR)):

    @entry(_name, cluster_sql(_threshold), threshold_clusters(_threshold))
    def _(spark, d, threshold=_threshold):
        loaded, found = found_clusters(spark, d, threshold)
        return clusters.ordered(clusters.cluster_table(loaded, found, threshold))


@entry(
    "c10_order",
    f"SELECT cluster, row_number() OVER (ORDER BY size, avg_d, max_d, gap DESC, ids) - 1 AS place FROM ({cluster_sql(NEAR)})",
    threshold_clusters(NEAR)
)
def _(spark, d):
    loaded, found = found_clusters(spark, d, NEAR)
    return in_order(checkpoint(clusters.ordered(clusters.cluster_table(loaded, found, NEAR)), wide=True).select("cluster"))


@entry("c11_consensus", """SELECT cluster, acc_id, count(*) FILTER (dosage <> c) AS n, count(*) AS d,
  count(*) FILTER (dosage <> c) / CAST(count(*) AS DOUBLE) AS agmr FROM (
  SELECT cl.cluster, g.acc_id, g.dosage, k.c FROM g JOIN cl ON cl.id = g.acc_id JOIN (
    SELECT cluster, marker, CASE WHEN count(*) FILTER (dosage = 0) >= 2/3 * count(*) THEN 0 WHEN
      count(*) FILTER (dosage = 1) >= 2/3 * count(*) THEN 1 WHEN count(*) FILTER (dosage = 2) >= 2/3 * count(*) THEN 2 END AS c
    FROM g JOIN cl ON cl.id = g.acc_id GROUP BY 1, 2) k ON k.cluster = cl.cluster AND k.marker = g.marker WHERE g.dosage IS NOT NULL AND k.c IS NOT NULL) GROUP BY 1, 2""", threshold_clusters(NEAR))
def _(spark, d):
    return clusters.consensus_distance(genotypes(spark, d), found_clusters(spark, d, NEAR)[1])


@entry("c12_linkage_tree")
def _(spark, d):
    return clusters.linkage_tree(clusters.load_pairs(distances(spark, d)))


@entry(
    "u1_u2_unique_genotypes", "SELECT acc_id, marker, dosage FROM g WHERE acc_id NOT IN (SELECT id FROM rp WHERE id <> rep)",
    threshold_clusters(0.035)
)
def _(spark, d):
    return dedup.unique_genotypes(genotypes(spark, d), found_clusters(spark, d, 0.035)[1]).select("acc_id", "marker", "dosage")


for _name, _threshold in (("u3_vote_pairs", 0.035), ("u3_vote_wide", NEAR)):

    @entry(_name, """SELECT acc_id, marker, dosage FROM g WHERE acc_id NOT IN (SELECT id FROM rp) UNION ALL
      SELECT rep, marker, CAST(CASE WHEN k = 2 THEN CASE WHEN (n0 > 0) + (n1 > 0) + (n2 > 0) > 1 THEN NULL WHEN n0 > 0 THEN 0
        WHEN n1 > 0 THEN 1 WHEN n2 > 0 THEN 2 END
        ELSE CASE WHEN 2 * n0 > k THEN 0 WHEN 2 * n1 > k THEN 1 WHEN 2 * n2 > k THEN 2 END END AS INT)
      FROM (SELECT rep, marker, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1,
        count(*) FILTER (dosage = 2) AS n2 FROM g JOIN rp ON rp.id = acc_id GROUP BY 1, 2)
      JOIN (SELECT rep, count(*) AS k FROM rp GROUP BY rep) USING (rep)""".replace("(n0 > 0) + (n1 > 0) + (n2 > 0) > 1", "CAST(n0 > 0 AS INT) + CAST(n1 > 0 AS INT) + CAST(n2 > 0 AS INT) > 1"), threshold_clusters(_threshold))
    def _(spark, d, threshold=_threshold):
        return dedup.voted_genotypes(genotypes(spark, d), found_clusters(spark, d, threshold)[1])


UPED = """, up AS (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY prog) AS k FROM ped),
ur AS (SELECT coalesce(a.rep, prog) AS prog, coalesce(b.rep, fpar) AS fpar, coalesce(c.rep, mpar) AS mpar, up.prog AS line FROM up LEFT JOIN rp a ON a.id = prog LEFT JOIN rp b ON b.id = fpar LEFT JOIN rp c ON c.id = mpar WHERE k = 1)"""


@entry(
    "u4_u7_unique_pedigrees",
    "SELECT prog, fpar, mpar FROM (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY CAST(fpar IS NULL "
    "AS INT) + CAST(mpar IS NULL AS INT), line) AS k FROM ur) WHERE k = 1",
    threshold_clusters(NEAR) + UPED
)
def _(spark, d):
    return dedup.unique_pedigrees(pedigrees(spark, d).withColumn("line", F.col("prog")), found_clusters(spark, d, NEAR)[1])


@entry("u5_columns_from_right", "SELECT fpar FROM ped")
def _(spark, d):
    return filters.select_columns(pedigrees(spark, d), [-2])


@entry(
    "u6_keep_share", f"SELECT DISTINCT acc_id FROM g WHERE acc_id NOT IN (SELECT id FROM rp WHERE id <> rep AND {u('1', 'id')} >= 0.5)",
    threshold_clusters(NEAR)
)
def _(spark, d):
    return dedup.keep_share(genotypes(spark, d), found_clusters(spark, d, NEAR)[1], 0.5).select("acc_id").distinct()


@entry("u8_consensus_tally", """SELECT marker, CAST(sum(greatest(n0, n1, n2)) AS BIGINT) AS winners,
  CAST(sum(n0 + n1 + n2 - greatest(n0, n1, n2)) AS BIGINT) AS others, CAST(sum(nx) AS BIGINT) AS missing FROM (
  SELECT rep, marker, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2, count(*) FILTER (dosage IS NULL) AS nx FROM g JOIN rp ON rp.id = acc_id GROUP BY 1, 2) GROUP BY marker""", threshold_clusters(NEAR))
def _(spark, d):
    return dedup.consensus_tally(genotypes(spark, d), found_clusters(spark, d, NEAR)[1])


# ---- candidate parents ------------------------------------------------------------------------------------------------------------

@entry("h1_bit_counts", "SELECT q_id, m_id, n02, n00_22, n01_12, n11 FROM pr WHERE hgmr <= 0.05", PAIRS)
def _(spark, d):
    return pairs.related_pairs(genotypes(spark, d), 0.05).select("q_id", "m_id", *pairs.COUNTS)


ROLES = ", ro AS (SELECT acc_id, CASE WHEN n0+n1+n2 <= 50 THEN 'b' WHEN n1 / CAST(n0+n1+n2 AS DOUBLE) <= 0.3 THEN 'p' WHEN n1 / CAST(n0+n1+n2 AS DOUBLE) >= 0.3 * 1.3 THEN 'o' ELSE 'b' END AS role FROM ac)"


@entry("h3_roles", "SELECT acc_id, role FROM ro", ACC + ROLES)
def _(spark, d):
    return cand.roles_by_heterozygosity(genotypes(spark, d), 0.3, 1.3, 50)


@entry(
    "h4_roles_by_pedigree",
    "SELECT acc_id, CASE WHEN acc_id IN (SELECT mpar FROM ped) OR acc_id IN (SELECT fpar FROM ped WHERE fpar IS NOT NULL) THEN 'b' "
    "ELSE 'o' END AS role FROM (SELECT DISTINCT acc_id FROM g)"
)
def _(spark, d):
    return cand.roles_by_pedigree(genotypes(spark, d), pedigrees(spark, d))


@entry("h2_candidates", "SELECT prog, par, n11, hgmr FROM cd", CAND)
def _(spark, d):
    return cand.candidates(genotypes(spark, d))


@entry(
    "h2_candidates_by_role",
    "SELECT prog, par, n11, hgmr FROM cd WHERE prog IN (SELECT acc_id FROM ro WHERE role IN ('o', 'b')) AND par IN (SELECT acc_id "
    "FROM ro WHERE role IN ('p', 'b'))",
    ACC + ROLES + CAND
)
def _(spark, d):
    g = genotypes(spark, d)
    return cand.candidates(g, cand.roles_by_heterozygosity(g, 0.3, 1.3, 50))


@entry(
    "h5_recorded_candidates",
    "SELECT prog, par, n11, hgmr FROM cd WHERE par IN (SELECT mpar FROM ped) OR par IN (SELECT fpar FROM ped WHERE fpar IS NOT NULL)",
    CAND
)
def _(spark, d):
    return cand.recorded_candidates(cand.candidates(genotypes(spark, d)), pedigrees(spark, d))


@entry("h6_candidates_of", "SELECT prog, par, n11, hgmr FROM cd WHERE prog IN (SELECT prog FROM ped)", CAND)
def _(spark, d):
    return cand.candidates_of(cand.candidates(genotypes(spark, d)), pedigrees(spark, d).select(F.col("prog").alias("acc_id")))


OVERLAP = ", ov AS (SELECT prog, par, count(*) FILTER (k.dosage = 1 AND i.dosage = 1) AS n11, count(*) FILTER (k.dosage = 1) AS n_het_prog, count(*) FILTER (i.dosage = 1) AS n_het_par FROM pp JOIN gk k ON k.acc_id = prog JOIN gk i ON i.acc_id = par AND i.marker = k.marker GROUP BY 1, 2)"
GK = ", gk AS (SELECT acc_id, marker, dosage FROM g WHERE dosage IS NOT NULL)"


def recorded_pairs(spark, d):
    p = pedigrees(spark, d)
    return p.select("prog", F.explode(F.array("fpar", "mpar")).alias("par")).filter("par is not null").distinct()


@entry("h7_het_het", "SELECT prog, par FROM ov WHERE n_het_par < 20 OR n11 > 0.6 * n_het_par", PAIRT + GK + OVERLAP)
def _(spark, d):
    p = recorded_pairs(spark, d)
    return cand.reject_het_het(p, cand.het_overlap(genotypes(spark, d), p), 20, 0.6)


@entry(
    "h8_top_candidates",
    "SELECT prog, par, hgmr, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY hgmr, par) "
    "AS rank FROM cd) WHERE rank <= 2",
    CAND
)
def _(spark, d):
    return cand.top_candidates(cand.candidates(genotypes(spark, d)), 2).select("prog", "par", "hgmr", "rank")


NUMBER = "CAST('0x' || substr(md5(concat_ws(':', '1', '{w}', id)), 1, 8) AS BIGINT)"
DRAWN = f""", an AS (SELECT acc_id, row_number() OVER (ORDER BY acc_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT acc_id FROM g)),
dr AS (SELECT o, (o + {NUMBER.format(w='a')} % (n - 1)) % n + 1 AS a, (o + {NUMBER.format(w='b')} % (n - 1)) % n + 1 AS b
  FROM (SELECT id, n, {NUMBER.format(w='o')} % n + 1 AS o FROM range(100000) t(id), (SELECT max(n) AS n FROM an))),
rd AS (SELECT x.acc_id AS prog, y.acc_id AS p1, z.acc_id AS p2, count(*) AS times FROM dr JOIN an x ON x.k = o JOIN an y ON y.k = a JOIN an z ON z.k = b GROUP BY 1, 2, 3)"""


@entry("h9_normalizing_means", """SELECT round(sum(times * hgmr1) / sum(times) FILTER (hgmr1 IS NOT NULL), 9) AS hgmr,
  round(sum(times * r1) / sum(times) FILTER (r1 IS NOT NULL), 9) AS r, round(sum(times * ftr) /
  sum(times) FILTER (ftr IS NOT NULL), 9) AS ftr,
  round(sum(times * z) / sum(times) FILTER (z IS NOT NULL), 9) AS z, round(sum(times * ftr_n) / sum(times) FILTER (ftr_n IS NOT NULL), 9) AS ftc FROM ts JOIN rd USING (prog, p1, p2)""", DRAWN + TRIPLE.format(t="rd"))
def _(spark, d):
    row = one(spark, parents.normalizing_means(genotypes(spark, d)), "hgmr double, r double, ftr double, z double, ftc double")
    return row.select(*(F.round(c, 9).alias(c) for c in row.columns))


@entry("h10_h11_expected_hgmr", """SELECT prog, par, seen, round(e, 6) AS expected, CASE WHEN e > 0 THEN round(seen / e, 6) END
  AS xhgmr FROM (
  SELECT prog, par, count(*) FILTER (abs(i.dosage - k.dosage) = 2) AS seen, sum(CASE i.dosage WHEN 0 THEN f2 WHEN 2 THEN f0
    ELSE 0.0 END) AS e
  FROM pp JOIN gk k ON k.acc_id = prog JOIN gk i ON i.acc_id = par AND i.marker = k.marker JOIN sh ON sh.marker = k.marker GROUP BY 1, 2)""", PAIRT + GK + SHARE)
def _(spark, d):
    return cand.expected_hgmr(genotypes(spark, d), recorded_pairs(spark, d))


@entry("h12_generalized_hgmr", """SELECT prog, par, n, d, CASE WHEN d > 0 THEN n / CAST(d AS DOUBLE) END AS hgmr FROM (
  SELECT prog, par, count(*) FILTER (abs(i.dosage - k.dosage) = 2) AS n, count(*) FILTER (i.dosage <> 1 AND k.dosage <> 1) AS d FROM pp JOIN gk k ON k.acc_id = prog JOIN gk i ON i.acc_id = par AND i.marker = k.marker GROUP BY 1, 2)""", PAIRT + GK)
def _(spark, d):
    return cand.generalized_hgmr(genotypes(spark, d), recorded_pairs(spark, d))


@entry("t14_het_overlap", "SELECT * FROM ov", PAIRT + GK + OVERLAP)
def _(spark, d):
    return cand.het_overlap(genotypes(spark, d), recorded_pairs(spark, d))


# ---- triples ----------------------------------------------------------------------------------------------------------------------

def recorded_triples(spark, d):
    return pedigrees(spark, d).select("prog", F.col("fpar").alias("p1"), F.col("mpar").alias("p2"))


@entry("t1_t7_triple_statistics", "SELECT * FROM ts", PEDT + TRIPLE.format(t="pt"))
def _(spark, d):
    return triples.statistics(triples.with_masks(recorded_triples(spark, d), pack(genotypes(spark, d))))


@entry("t6_t16_one_parent", """SELECT prog, par, CASE WHEN m + s > 0 THEN m / CAST(m + s AS DOUBLE) END AS hgmr, CASE
  WHEN m + h + s > 0 THEN (m + h) / CAST(m + h + s AS DOUBLE) END AS r_all, CASE WHEN h + s > 0 THEN h / CAST(h + s AS DOUBLE)
  END AS r FROM (
  SELECT prog, par, count(*) FILTER (abs(i.dosage - k.dosage) = 2) AS m, count(*) FILTER (i.dosage = k.dosage AND i.dosage <> 1) AS s, count(*) FILTER (i.dosage <> 1 AND k.dosage = 1) AS h FROM pp JOIN gk k ON k.acc_id = prog JOIN gk i ON i.acc_id = par AND i.marker = k.marker GROUP BY 1, 2)""", PAIRT + GK)
def _(spark, d):
    return triples.one_parent(genotypes(spark, d), recorded_pairs(spark, d))


@entry(
    "t7_normalized", "SELECT prog, ftr / 0.25 AS ftr, hgmr1 / 0.5 AS hgmr1, r2 / 0.4 AS r2, z / 0.2 AS z FROM ts",
    PEDT + TRIPLE.format(t="pt")
)
def _(spark, d):
    return triples.statistics(
        triples.with_masks(recorded_triples(spark, d), pack(genotypes(spark, d))), {"hgmr": 0.5, "r": 0.4, "ftr": 0.25, "z": 0.2}
    ).select("prog", "ftr", "hgmr1", "r2", "z")


TL = PEDT + ", tl AS (SELECT t.*, k.marker, i.dosage AS i, j.dosage AS j, k.dosage AS k FROM pt t JOIN g k ON k.acc_id = prog AND k.dosage IS NOT NULL JOIN g i ON i.acc_id = p1 AND i.marker = k.marker AND i.dosage IS NOT NULL JOIN g j ON j.acc_id = p2 AND j.marker = k.marker AND j.dosage IS NOT NULL)"
FORBID = "(i = 0 AND j = 0 AND k > 0) OR (i = 2 AND j = 2 AND k < 2) OR (i + j = 1 AND k = 2) OR (i + j = 3 AND k = 0) OR (i + j = 2 AND i <> j AND k <> 1)"


@entry(
    "t10_state_counts",
    f"""SELECT i, j, k, count(*) AS n, CAST(CASE WHEN {FORBID} THEN 1 ELSE 0 END + CASE WHEN i = j AND i <> 1 AND abs(i - k) = 2 THEN 1 ELSE 0 END AS INT) AS weight, {FORBID} AS forbidden FROM tl GROUP BY i, j, k""",
    TL
)
def _(spark, d):
    return triples.state_counts(genotypes(spark, d), recorded_triples(spark, d))


@entry("t8_t9_expected_forbidden", f"""SELECT prog, p1, p2, seen, round(e, 6) AS expected, round(seen / nullif(e, 0), 6) AS xftr,
  seen / CAST(n AS DOUBLE) AS rate, round(0.5 * round(seen / nullif(e, 0), 6) + 0.5 * (seen / CAST(n AS DOUBLE)), 6) AS xxftr
  FROM (
  SELECT prog, p1, p2, count(*) FILTER ({FORBID}) AS seen, count(*) AS n, sum(CASE WHEN i = 0 AND j = 0 THEN f1 + f2 WHEN i = 2 AND j = 2 THEN f0 + f1 WHEN i + j = 1 THEN f2 WHEN i + j = 3 THEN f0 WHEN i <> j THEN f0 + f2 ELSE 0.0 END) AS e FROM tl JOIN sh USING (marker) GROUP BY 1, 2, 3)""", TL + SHARE)
def _(spark, d):
    return triples.mixed_rate(triples.expected_forbidden(genotypes(spark, d), recorded_triples(spark, d)))


@entry(
    "t11_pedigree_class",
    """SELECT prog, CASE WHEN ftr IS NULL OR agmr12 IS NULL THEN 'unclear' WHEN agmr12 <= 0.04 AND hgmr1 <= 0.05 AND r1 <= 0.15 THEN 'self' WHEN ftr <= 0.05 AND hgmr1 <= 0.05 AND hgmr2 <= 0.05 THEN 'biparental' WHEN hgmr1 <= 0.05 OR hgmr2 <= 0.05 THEN 'one' ELSE 'none' END AS class FROM ts""",
    PEDT + TRIPLE.format(t="pt")
)
def _(spark, d):
    return triples.pedigree_class(
        triples.statistics(triples.with_masks(recorded_triples(spark, d), pack(genotypes(spark, d))))
    ).select("prog", "class")


GIVEN = "ln(0.99 * (CASE {p} WHEN 0 THEN (CASE {c} WHEN 0 THEN 1 - q WHEN 1 THEN q ELSE 0.0 END) WHEN 1 THEN (CASE {c} WHEN 0 THEN (1 - q) / 2 WHEN 1 THEN 0.5 ELSE q / 2 END) ELSE (CASE {c} WHEN 0 THEN 0.0 WHEN 1 THEN 1 - q ELSE q END) END) + 0.01 / 3)"


@entry("t12_t13_t15_direction", f"""SELECT prog, par, round(sum({GIVEN.format(p='i', c='k')}), 6) AS log_par_prog,
  round(sum({GIVEN.format(p='k', c='i')}), 6) AS log_prog_par,
  round(sum(ln(0.99 * (CASE k WHEN 0 THEN (1 - q) * (1 - q) WHEN 1 THEN 2 * q * (1 - q) ELSE q * q END) + 0.01 / 3)), 6)
    AS log_chance, count(*) FILTER (i = 0 AND k = 1) AS n01, count(*) FILTER (i = 1 AND k = 0) AS n10, count(*) FILTER (i = 1
    AND k = 2) AS n12, count(*) FILTER (i = 2 AND k = 1) AS n21
  FROM (SELECT prog, par, i.dosage AS i, k.dosage AS k, q FROM pp JOIN gk k ON k.acc_id = prog JOIN gk i ON i.acc_id = par AND i.marker = k.marker JOIN sh ON sh.marker = k.marker WHERE q > 0 AND q < 1) GROUP BY 1, 2""", PAIRT + GK + SHARE)
def _(spark, d):
    return triples.direction(genotypes(spark, d), recorded_pairs(spark, d))


# ---- parent search ----------------------------------------------------------------------------------------------------------------

BLOCK = "prog, kind, rank, fpar, mpar, n_good, agmr12, hgmr1, r1, hgmr2, r2, ftr, x_f, nhet_f, x_m, nhet_m, acc"


def crossed(source: str, alias: str) -> str:
    """source (prog, p1, p2, statistics...) with crossover columns, as a common table; its pairs must be in xx."""
    return f""", {alias} AS (SELECT s.*, CASE WHEN p1 IS NOT NULL THEN coalesce(f.x, 0) END AS x_f, CASE
      WHEN p1 IS NOT NULL THEN coalesce(f.n_het, 0) END AS nhet_f,
  CASE WHEN p2 IS NOT NULL THEN coalesce(m.x, 0) END AS x_m, CASE WHEN p2 IS NOT NULL THEN coalesce(m.n_het, 0) END AS nhet_m,
  CASE WHEN p1 IS NULL THEN coalesce(m.x, 0) WHEN p2 IS NULL THEN coalesce(f.x, 0) ELSE greatest(coalesce(f.x, 0), coalesce(m.x,
    0)) END AS acc
  FROM {source} s LEFT JOIN xx f ON f.prog = s.prog AND f.par = s.p1 LEFT JOIN xx m ON m.prog = s.prog AND m.par = s.p2)"""


CHECK = PEDT + TRIPLE.format(t="pt") + PAIRT + CROSS.format(t="pp") + crossed("ts", "ck")
CHECK_SQL = "SELECT prog, 'P' AS kind, 0 AS rank, p1 AS fpar, p2 AS mpar, n_good, agmr12, hgmr1, r1, hgmr2, r2, ftr, x_f, nhet_f, x_m, nhet_m, acc FROM ck"


@entry("q1_candidate_pairs", "SELECT prog, p1, p2 FROM q1", ALT)
def _(spark, d):
    return parents.candidate_pairs(cand.top_candidates(cand.candidates(genotypes(spark, d))))


@entry("q2_q4_best_pairs", "SELECT prog, p1, p2, ftr, CAST(rank AS INT) AS rank FROM bs", BEST)
def _(spark, d):
    g = genotypes(spark, d)
    return parents.alternatives(g, cand.candidates(g), phased=False).select("prog", "p1", "p2", "ftr", "rank")


@entry(
    "q3_by_hgmr",
    "SELECT prog, p1, p2, ftr, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prog "
    "ORDER BY greatest(hgmr1, hgmr2), p1, p2) AS rank FROM ts WHERE ftr <= 0.5) WHERE rank <= 2",
    ALT + TRIPLE.format(t="q1")
)
def _(spark, d):
    g = genotypes(spark, d)
    pairs_ = parents.candidate_pairs(cand.top_candidates(cand.candidates(g)))
    return parents.rank_pairs(
        triples.statistics(triples.with_masks(pairs_, pack(g))), "hgmr", most=2
    ).select("prog", "p1", "p2", "ftr", "rank")


@entry("q5_q6_level0", CHECK_SQL, CHECK)
def _(spark, d):
    return parents.find_parents(genotypes(spark, d), pedigrees(spark, d), 0)


# the alternatives' crossovers: the best pairs' parents
ALTX = ", bp AS (SELECT prog, p1 AS par FROM bs UNION SELECT prog, p2 FROM bs)" + CROSS.format(t="bp") + crossed("bs", "bx")
ALTX_SQL = "SELECT prog, 'A' AS kind, CAST(rank AS INT) AS rank, p1 AS fpar, p2 AS mpar, n_good, agmr12, hgmr1, r1, hgmr2, r2, ftr, x_f, nhet_f, x_m, nhet_m, acc FROM bx"
NONE_SQL = "SELECT prog, 'A', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({everyone}) WHERE prog NOT IN (SELECT prog FROM bs)"


@entry("q6_no_pedigrees", f"{ALTX_SQL} UNION ALL {NONE_SQL.format(everyone='SELECT DISTINCT acc_id AS prog FROM g')}", BEST + ALTX)
def _(spark, d):
    return parents.find_parents(genotypes(spark, d), None)


def renamed(sql: str, suffix: str, names: str) -> str:
    """Common tables under other names, so that two sets of them fit in one query."""
    import re

    return re.sub(rf"\b({'|'.join(names.split())})\b", rf"\1{suffix}", sql)


_CHECK2 = renamed(CHECK, "_c", "pt tk tc ts pp xm xs xl xx ck")
_CHECK2_SQL = renamed(CHECK_SQL, "_c", "ck")


def level_sql(level: int) -> str:
    everyone = "SELECT DISTINCT acc_id AS prog FROM g" if level != 2 else "SELECT prog FROM ck_c WHERE coalesce(ftr, 100) > 0.025"
    out = f"{ALTX_SQL} UNION ALL {NONE_SQL.format(everyone=everyone)} UNION ALL {_CHECK2_SQL}"
    if level in (1, 3):
        out += " UNION ALL SELECT DISTINCT acc_id, 'P', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE acc_id NOT IN (SELECT prog FROM ck_c)"
    return out


_LIMIT = {
    1: "", 2: " AND prog IN (SELECT prog FROM ck_c WHERE coalesce(ftr, 100) > 0.025)",
    3: " AND (par IN (SELECT mpar FROM ped) OR par IN (SELECT fpar FROM ped WHERE fpar IS NOT NULL))"
}

for _level in (1, 2, 3):

    @entry(
        f"q6_q7_q8_level{_level}", level_sql(_level),
        _CHECK2 + BEST.replace("AS rank FROM cd)", f"AS rank FROM cd WHERE true{_LIMIT[_level]})") + ALTX
    )
    def _(spark, d, level=_level):
        return parents.find_parents(genotypes(spark, d), pedigrees(spark, d), level)


@entry(
    "q9_wide_output",
    "SELECT coalesce(c.prog, a.prog) AS prog, c.p1 AS fpar, c.p2 AS mpar, c.ftr, a.p1 AS fpar_1, a.p2 AS mpar_1, a.ftr AS ftr_1 "
    "FROM ck_c c FULL JOIN (SELECT * FROM bx WHERE rank = 1) a ON a.prog = c.prog",
    _CHECK2 + BEST + ALTX
)
def _(spark, d):
    rows = checkpoint(parents.find_parents(genotypes(spark, d), pedigrees(spark, d), 1).filter("fpar is not null or mpar is not null"))
    return parents.wide_output(rows, 1).select("prog", "fpar", "mpar", "ftr", "fpar_1", "mpar_1", "ftr_1")


@entry("q11_pedigree_test", """SELECT ts.*, ac.n_missing AS md, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN tc.n_good END
  AS agmr12_d, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN tc.n_good END AS ftr_d, CASE WHEN p1 IS NOT NULL
  AND p2 IS NOT NULL THEN n_hom END AS z_d,
  CASE WHEN p1 IS NOT NULL THEN m1 + s1 END AS hgmr1_d, CASE WHEN p2 IS NOT NULL THEN m2 + s2 END AS hgmr2_d,
  CASE WHEN p1 IS NOT NULL THEN CASE WHEN p2 IS NULL THEN m1 ELSE 0 END + h1 + s1 END AS r1_d, CASE WHEN p2 IS NOT NULL THEN CASE
    WHEN p1 IS NULL THEN m2 ELSE 0 END + h2 + s2 END AS r2_d
  FROM ts JOIN (SELECT * EXCLUDE (p1, p2) FROM tc) tc USING (prog) JOIN ac ON ac.acc_id = prog""", ACC + PEDT + TRIPLE.format(t="pt"))
def _(spark, d):
    return parents.pedigree_test(genotypes(spark, d), pedigrees(spark, d))


@entry("q12_other_pairs", "SELECT prog, p1, p2, ftr FROM ts", CAND + """, r80 AS (SELECT prog, par FROM (SELECT *, row_number()
  OVER (PARTITION BY prog ORDER BY hgmr, par) AS rank FROM cd WHERE prog IN (SELECT prog FROM ped)) WHERE rank <= 80
  UNION SELECT prog, fpar FROM ped WHERE fpar IS NOT NULL UNION SELECT prog, mpar FROM ped),
o12 AS (SELECT a.prog, a.par AS p1, b.par AS p2 FROM r80 a JOIN r80 b ON a.prog = b.prog AND a.par <= b.par ANTI JOIN (SELECT prog, least(fpar, mpar) AS p1, greatest(fpar, mpar) AS p2 FROM ped WHERE fpar IS NOT NULL) r ON r.prog = a.prog AND r.p1 = a.par AND r.p2 = b.par)""" + TRIPLE.format(t="o12"))
def _(spark, d):
    g = genotypes(spark, d)
    p = pedigrees(spark, d)
    return parents.other_pairs(g, cand.candidates(g), p).select("prog", "p1", "p2", "ftr")


# ---- phase ------------------------------------------------------------------------------------------------------------------------

@entry("x1_crossovers", "SELECT prog, par, x, n_het FROM xx", PAIRT + CROSS.format(t="pp"))
def _(spark, d):
    return phasing.crossovers(genotypes(spark, d), recorded_pairs(spark, d))


@entry("x2_parent_crossovers", "SELECT * FROM px", PEDT + PAIRT + CROSS.format(t="pp") + crossed("pt", "px"))
def _(spark, d):
    return phasing.parent_crossovers(genotypes(spark, d), recorded_triples(spark, d))


def hypotheses(single: bool) -> str:
    def count(c: str) -> str:
        less = f" AND NOT coalesce(lead_{c} <> {c}, false) AND NOT coalesce(lag2_{c} = {c}, false)" if single else ""
        return f"count(*) FILTER ({c} <> lag_{c}{less}) AS x{c}"

    case = "CASE WHEN k = 0 THEN ph = -1 WHEN k = 2 THEN ph = 1 WHEN kp = {0} THEN ph = -1 WHEN kp = -{0} THEN ph = 1 END"
    lags = ", ".join(f"lag({c}) OVER w AS lag_{c}, lead({c}) OVER w AS lead_{c}, lag({c}, 2) OVER w AS lag2_{c}" for c in "ab")
    return PAIRT + GK + CROSS.format(t="pp") + f""", ha AS (SELECT *, {case.format(1)} AS a,
      {case.format(1).replace('kp = 1', 'kp = 0').replace('kp = -1', 'kp = 1').replace('kp = 0', 'kp = -1')} AS b FROM xm
      WHERE k <> 1 OR kp IS NOT NULL),
hl AS (SELECT *, {lags} FROM ha WINDOW w AS (PARTITION BY prog, par, chrom ORDER BY marker)),
hx AS (SELECT prog, par, chrom, {count('a')}, {count('b')}, count(*) AS n_het FROM hl GROUP BY 1, 2, 3),
hh AS (SELECT prog, par, k.marker // 16 + 1 AS chrom, count(*) FILTER (abs(i.dosage - k.dosage) = 2) AS n02,
  count(*) FILTER (i.dosage <> 1 AND k.dosage <> 1) AS n_hom FROM pp JOIN gk k ON k.acc_id = prog JOIN gk i ON i.acc_id = par
  AND i.marker = k.marker GROUP BY 1, 2, 3),
hy AS (SELECT prog, par, CAST(chrom AS INT) AS chrom, coalesce(xa, 0) AS xa, coalesce(xb, 0) AS xb, least(coalesce(xa, 0), coalesce(xb, 0)) AS x_min, greatest(coalesce(xa, 0), coalesce(xb, 0)) AS x_max, coalesce(n_het, 0) AS n_het, n02, n_hom FROM hh LEFT JOIN hx USING (prog, par, chrom))"""


@entry("x3_chromosome_hypotheses", "SELECT * FROM hy", hypotheses(False))
def _(spark, d):
    return phasing.chromosome_hypotheses(genotypes(spark, d), recorded_pairs(spark, d))


KNOWN3 = PEDT + """, k3 AS (SELECT t.prog, t.p1, t.p2, k.chrom, k.marker, k.dosage AS k, k.phase AS kp, i.dosage AS i, i.phase
  AS ip, j.dosage AS j, j.phase AS jp FROM pt t
  JOIN g k ON k.acc_id = t.prog AND k.dosage IS NOT NULL JOIN g i ON i.acc_id = t.p1 AND i.marker = k.marker AND i.dosage IS NOT NULL JOIN g j ON j.acc_id = t.p2 AND j.marker = k.marker AND j.dosage IS NOT NULL)"""


def sides() -> str:
    """Changes (x), by parent and hypothesis, each from the rows where the parent is a phased heterozygote and the side is known."""
    out, joined = "", []
    for t, g in ((1, "i"), (2, "j")):
        for c, plus in (("a", 1), ("b", -1)):
            side = f"CASE WHEN k = 0 THEN {g}p = -1 WHEN k = 2 THEN {g}p = 1 WHEN kp = {plus} THEN {g}p = -1 ELSE {g}p = 1 END"
            out += f""", s{c}{t} AS (SELECT prog, p1, p2, chrom, count(*) FILTER (s <> b) AS x FROM (SELECT *, lag(s)
              OVER (PARTITION BY prog, p1, p2, chrom ORDER BY marker) AS b FROM (
              SELECT *, {side} AS s FROM k3 WHERE {g} = 1 AND {g}p IS NOT NULL AND (k <> 1 OR kp IS NOT NULL))) GROUP BY ALL)"""
            joined.append(f"LEFT JOIN s{c}{t} USING (prog, p1, p2, chrom)")
    counts = ", ".join(
        f"count(*) FILTER (k = 1 AND ({g} = 0 AND kp = -1 OR {g} = 2 AND kp = 1)) AS fa{t}, count(*) FILTER (k = 1 AND ({g} = 0 "
        f"AND kp = 1 OR {g} = 2 AND kp = -1)) AS fb{t}, "
        f"count(*) FILTER ({g} = 1) AS n_het{t}, count(*) FILTER (abs({g} - k) = 2) AS f02_{t}, count(*) FILTER ({g} <> 1) AS n_hom{t}"
        for t, g in ((1, "i"), (2, "j"))
    )
    x = ", ".join(f"coalesce(s{c}{t}.x, 0) AS x{c}{t}" for t in (1, 2) for c in "ab")
    return out + f""", c3 AS (SELECT prog, p1, p2, chrom, {counts} FROM k3 GROUP BY 1, 2, 3, 4),
x3 AS (SELECT c3.*, {x} FROM c3 {' '.join(joined)}),
y3 AS (SELECT *, xa1 + xb2 AS x_ab, xb1 + xa2 AS x_ba, fa1 + fb2 AS f_ab, fb1 + fa2 AS f_ba FROM x3),
z3 AS (SELECT *, x_ab < x_ba AS ab, (x_ab < x_ba) = (f_ab < f_ba) AS agrees, CASE WHEN x_ab < x_ba THEN xa1 ELSE xb1 END AS min1,
  CASE WHEN x_ab < x_ba THEN xb1 ELSE xa1 END AS max1,
  CASE WHEN x_ab < x_ba THEN xb2 ELSE xa2 END AS min2, CASE WHEN x_ab < x_ba THEN xa2 ELSE xb2 END AS max2 FROM y3)"""


@entry("x3_two_parents", "SELECT * FROM z3", KNOWN3 + sides())
def _(spark, d):
    return phasing.triple_hypotheses(genotypes(spark, d), recorded_triples(spark, d))


@entry(
    "x3_totals",
    "SELECT prog, p1, p2, " + ", ".join(
        f"CAST(sum(least(xa{t}, xb{t})) AS BIGINT) AS alone_min{t}, CAST(sum(greatest(xa{t}, xb{t})) AS BIGINT) AS alone_max{t}, "
        f"CAST(sum(n_het{t}) AS BIGINT) AS n_het{t}, CAST(sum(min{t}) AS BIGINT) AS min{t}, CAST(sum(max{t}) AS BIGINT) AS max{t}" for t in (1, 2)
    ) + " FROM z3 GROUP BY 1, 2, 3",
    KNOWN3 + sides()
)
def _(spark, d):
    return phasing.hypothesis_totals(phasing.triple_hypotheses(genotypes(spark, d), recorded_triples(spark, d)))


@entry("x4_phase_correction", """SELECT m.prog, m.p1, m.p2, m.chrom, n, CAST(ab AS BIGINT) AS ab, CAST(ba AS BIGINT) AS ba,
  CAST(least(ab, ba) AS BIGINT) AS misfits, CAST(f.c AS BIGINT) AS ab_ba, CAST(r.c AS BIGINT) AS ba_ab, CAST(least(f.c, r.c)
  AS BIGINT) AS misfits_left,
  CAST(CASE WHEN f.c < r.c OR f.c = r.c AND f.spot >= r.spot THEN floor((f.low + f.high) / 2) ELSE floor((r.low + r.high) / 2)
    END AS INT) AS switch_from
  FROM m JOIN f USING (prog, p1, p2, chrom) JOIN r USING (prog, p1, p2, chrom)""", KNOWN3 + """, w AS (
  SELECT prog, p1, p2, chrom, marker, CASE WHEN i = 1 THEN 0 ELSE CAST((i = 0) = (kp = -1) AS INT) END + CASE WHEN j = 1 THEN 0
    ELSE CAST((j = 0) = (kp = 1) AS INT) END AS ab,
    CASE WHEN i = 1 THEN 0 ELSE CAST((i = 0) = (kp = 1) AS INT) END + CASE WHEN j = 1 THEN 0 ELSE CAST((j = 0) = (kp = -1) AS INT) END AS ba
  FROM k3 WHERE k = 1 AND kp IS NOT NULL AND i <> j),
m AS (SELECT prog, p1, p2, chrom, count(*) AS n, sum(ab) AS ab, sum(ba) AS ba FROM w GROUP BY 1, 2, 3, 4),
e AS (SELECT prog, p1, p2, chrom, marker, row_number() OVER o AS spot, sum(ab) OVER o AS sab, sum(ba) OVER o AS sba, marker
  AS low, lead(marker) OVER o AS high FROM w WINDOW o AS (PARTITION BY prog, p1, p2, chrom ORDER BY marker)
  UNION ALL SELECT prog, p1, p2, chrom, -1, 0, 0, 0, -1, min(marker) FROM w GROUP BY prog, p1, p2, chrom),
f AS (SELECT prog, p1, p2, chrom, sab + ba - sba AS c, spot, low, high FROM e JOIN m USING (prog, p1, p2, chrom)
  QUALIFY row_number() OVER (PARTITION BY prog, p1, p2, chrom ORDER BY sab + ba - sba, spot) = 1),
r AS (SELECT prog, p1, p2, chrom, sba + ab - sab AS c, spot, low, high FROM e JOIN m USING (prog, p1, p2, chrom) QUALIFY row_number() OVER (PARTITION BY prog, p1, p2, chrom ORDER BY sba + ab - sab, spot) = 1)""")
def _(spark, d):
    return phasing.phase_correction(genotypes(spark, d), recorded_triples(spark, d))


@entry("x5_x6_without_single_switches", "SELECT * FROM hy", hypotheses(True))
def _(spark, d):
    return phasing.chromosome_hypotheses(genotypes(spark, d), recorded_pairs(spark, d), True)


X7 = """, tt AS (SELECT prog, par, CAST(sum(x_min) AS BIGINT) AS x_min, CAST(sum(x_max) AS BIGINT) AS x_max, CAST(sum(n_het) AS BIGINT) AS n_het, CASE WHEN sum(n_het) > 0 THEN sum(x_min) / CAST(sum(n_het) AS DOUBLE) END AS rate FROM hy GROUP BY 1, 2)"""
_BOTHWAYS = hypotheses(False).replace(
    PAIRT, PAIRT.replace(", pp AS", ", p0 AS") + ", pp AS (SELECT prog, par FROM p0 UNION SELECT par, prog FROM p0)"
)


@entry(
    "x7_pair_totals",
    "SELECT t.*, r.x_min AS rev_x_min, r.x_max AS rev_x_max, r.n_het AS rev_n_het, r.rate AS rev_rate FROM tt t LEFT JOIN tt r "
    "ON r.prog = t.par AND r.par = t.prog",
    _BOTHWAYS + X7
)
def _(spark, d):
    p = recorded_pairs(spark, d)
    both = p.unionByName(p.select(F.col("par").alias("prog"), F.col("prog").alias("par"))).distinct()
    return phasing.pair_totals(checkpoint(phasing.chromosome_hypotheses(genotypes(spark, d), both)))


@entry("x8_triple_quality", """SELECT t.prog, p1, p2, CAST(sum(a.x_min) AS BIGINT) AS min1, CAST(sum(b.x_min) AS BIGINT) AS min2,
  CAST(sum(least(a.xa + b.xb, a.xb + b.xa)) AS BIGINT) AS consistent, count(*) FILTER (least(a.xa + b.xb, a.xb + b.xa) > 3)
  AS n_bad
  FROM pt t JOIN hy a ON a.prog = t.prog AND a.par = p1 JOIN hy b ON b.prog = t.prog AND b.par = p2 AND b.chrom = a.chrom GROUP BY 1, 2, 3""", PEDT + hypotheses(False))
def _(spark, d):
    h = checkpoint(phasing.chromosome_hypotheses(genotypes(spark, d), recorded_pairs(spark, d)))
    return phasing.triple_quality(h, recorded_triples(spark, d))


@entry(
    "x9_annotated_pairs",
    "SELECT cd.prog, par, CASE WHEN par = fpar AND par = mpar THEN 'FM' WHEN par = fpar THEN 'F' WHEN par = mpar THEN 'M' END "
    "AS recorded FROM cd LEFT JOIN ped ON ped.prog = cd.prog",
    CAND
)
def _(spark, d):
    return phasing.annotate_pairs(cand.candidates(genotypes(spark, d)), pedigrees(spark, d)).select("prog", "par", "recorded")


# ---- one-dimensional clusters -----------------------------------------------------------------------------------------------------

SPLITS = """, vx AS (SELECT agmr AS x, count(*) AS n FROM pr GROUP BY agmr), sp AS (
  SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER l AS nl, sum(n*x) OVER l AS sl, sum(n*x*x) OVER l AS ql, sum(n) OVER () AS nt, sum(n*x) OVER () AS st, sum(n*x*x) OVER () AS qt FROM vx WINDOW l AS (ORDER BY x ROWS UNBOUNDED PRECEDING))"""


def agmr_values(spark, d):
    return checkpoint(pairs.distance_counts(genotypes(spark, d)))


@entry("d1_left_boundary", """SELECT 4 * bq.i AS n_left, round(bq.h, 9) AS threshold, round(CAST(bq.q AS DOUBLE), 6) AS quality,
  round((SELECT h FROM gq, tq WHERE gq.place = tq.place - 16), 9) AS smooth,
  round((SELECT CAST(s AS DOUBLE) / 33 FROM tq), 3) AS smooth_quality, round((SELECT min(gq.h) FROM gq, bq WHERE gq.q >= bq.q / 2), 9) AS left_edge, round((SELECT max(gq.h) FROM gq, bq WHERE gq.q >= bq.q / 2), 9) AS right_edge FROM bq""", LEFT)
def _(spark, d):
    names = ("n_left", "threshold", "quality", "smooth", "smooth_quality", "left_edge", "right_edge")
    found = cluster1d.left_boundary(agmr_values(spark, d)) or dict.fromkeys(names)
    row = one(
        spark, found,
        "n_left bigint, threshold double, quality double, smooth double, smooth_quality double, left_edge double, right_edge double"
    )
    return row.select("n_left", *(F.round(n, {"quality": 6, "smooth_quality": 3}.get(n, 9)).alias(n) for n in names[1:]))


@entry(
    "d2_two_means",
    "SELECT CAST(nl AS BIGINT) AS n_left, round((x + nx) / 2, 9) AS threshold, round(w, 6) AS within FROM (SELECT *, "
    "ql - sl*sl/nl + (qt - ql) - (st - sl)*(st - sl)/(nt - nl) AS w FROM sp WHERE nx IS NOT NULL) ORDER BY w, x LIMIT 1",
    PAIRS + SPLITS
)
def _(spark, d):
    return cluster1d.two_means(agmr_values(spark, d))


@entry("d3_density_split")
def _(spark, d):
    found = cluster1d.density_split(agmr_values(spark, d)) or dict.fromkeys(("n_left", "threshold", "density", "quality"))
    return one(spark, found, "n_left bigint, threshold double, density double, quality double")


@entry(
    "d4_jenks",
    "SELECT CAST(nl AS BIGINT) AS n_left, round((x + nx) / 2, 9) AS threshold, round(w, 6) AS between FROM (SELECT *, "
    "sl*sl/nl + (st - sl)*(st - sl)/(nt - nl) AS w FROM sp WHERE nx IS NOT NULL) ORDER BY w DESC, x LIMIT 1".replace(
        "AS between", 'AS "between"'
    ),
    PAIRS + SPLITS
)
def _(spark, d):
    return cluster1d.jenks(agmr_values(spark, d))


@entry("d5_separation", """SELECT round(4 * 0.05 * (max(x) FILTER (k = CAST(floor(0.75 * l)
  AS BIGINT)) - max(x) FILTER (k = CAST(floor(0.25 * l) AS BIGINT)))
  / greatest(max(x) FILTER (k = l + CAST(floor(0.05 * l) AS BIGINT)) - max(x) FILTER (k = l - CAST(floor(0.05 * l) AS BIGINT)),
    1e-9), 9) AS quality
  FROM vr, (SELECT CAST(nl AS BIGINT) AS l FROM (SELECT *, ql - sl*sl/nl + (qt - ql) - (st - sl)*(st - sl)/(nt - nl) AS w FROM sp WHERE nx IS NOT NULL) ORDER BY w, x LIMIT 1)""", PAIRS + SPLITS + RANKED)
def _(spark, d):
    x = agmr_values(spark, d)
    row = one(spark, {"q": cluster1d.separation(x, int(cluster1d.two_means(x).first()["n_left"]))}, "quality double")
    return row.select(F.round("quality", 9).alias("quality"))


@entry("d6_transform", "SELECT round(ln(greatest(agmr, 0.001)), 9) AS x, count(*) AS n FROM pr WHERE agmr <= 0.2 GROUP BY 1", PAIRS)
def _(spark, d):
    x = pairs.similar_pairs(genotypes(spark, d), NEAR).select(F.col("agmr").alias("x"))
    return cluster1d.transform(x, "log").select(F.round("x", 9).alias("x")).groupBy("x").agg(F.count("*").alias("n"))


def log_split(name: str, *columns: str) -> str:
    """Common tables that end in {name} with a threshold t: the two-means split of the columns' logarithms."""
    each = " UNION ALL ".join(f"SELECT ln(greatest({c}, 0.001)) AS x FROM ts WHERE {c} IS NOT NULL" for c in columns)
    return f""", {name}v AS (SELECT x, count(*) AS n FROM ({each}) GROUP BY x), {name}s AS (
  SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER l AS nl, sum(n*x) OVER l AS sl, sum(n*x*x) OVER l AS ql, sum(n) OVER ()
    AS nt, sum(n*x) OVER () AS st, sum(n*x*x) OVER () AS qt FROM {name}v WINDOW l AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT exp(round((x + nx) / 2, 9)) AS t FROM {name}s WHERE nx IS NOT NULL ORDER BY round(ql - sl*sl/nl + (qt - ql) - (st - sl)*(st - sl)/(nt - nl), 9), x LIMIT 1)"""


MARKED = "".join(
    log_split(n, *cols) for n,
    cols in {"ta": ["agmr12"], "th": ["hgmr1", "hgmr2"], "tr": ["r1", "r2"], "tz": ["z"], "tf": ["ftr"]}.items()
)
_MARK = "CASE WHEN {c} IS NULL THEN 'x' WHEN {c} <= {t}.t THEN '0' ELSE '1' END"
_MARKS = [
    _MARK.format(c=c, t=t) for c,
    t in (("agmr12", "ta"), ("hgmr1", "th"), ("r1", "tr"), ("hgmr2", "th"), ("r2", "tr"), ("z", "tz"), ("ftr", "tf"))
]
CATEGORY = f"({_MARKS[0]}) || ' ' || ({_MARKS[1]}) || ({_MARKS[2]}) || ' ' || ({_MARKS[3]}) || ({_MARKS[4]}) || ' ' || ({_MARKS[5]}) || ({_MARKS[6]})"


@entry(
    "d7_categories", f"SELECT {CATEGORY} AS category, count(*) AS n FROM ts, ta, th, tr, tz, tf GROUP BY 1",
    PEDT + TRIPLE.format(t="pt") + MARKED
)
def _(spark, d):
    rows = checkpoint(triples.statistics(triples.with_masks(recorded_triples(spark, d), pack(genotypes(spark, d)))))
    return cluster1d.categories(rows, cluster1d.category_thresholds(rows)).groupBy("category").agg(F.count("*").alias("n"))


@entry("d7_best_pedigrees", f"""SELECT prog, n_good, CASE v WHEN 2 THEN 'ped' WHEN 1 THEN 'alt' ELSE 'none' END AS verdict,
  max(p) FILTER (k = 1) AS first, max(p) FILTER (k = 2) AS second FROM (
  SELECT *, CASE WHEN shown THEN row_number() OVER (PARTITION BY prog ORDER BY CASE WHEN shown THEN 0 ELSE 1 END, CASE
    WHEN kind = 'P' AND v = 2 THEN 0 ELSE 1 END, length(category) - length(replace(category, 'x', '')), ftr, p1, p2) END AS k,
    concat_ws(' ', kind, p1, p2, category) AS p FROM (
    SELECT *, kind = 'P' AND v = 2 OR ftr IS NOT NULL AND (v = 0 OR good AND kind = 'A') AS shown FROM (
      SELECT *, coalesce(max(CASE WHEN good AND kind = 'P' THEN 2 WHEN good AND ftr IS NOT NULL THEN 1 END)
        OVER (PARTITION BY prog), 0) AS v, count(*) FILTER (good) OVER (PARTITION BY prog) AS n_good FROM (
        SELECT prog, p1, p2, ftr, kind, category, category IN ('0 00 00 00', '1 01 01 00') AS good FROM (
          SELECT all_.*, {CATEGORY} AS category FROM (SELECT *, 'P' AS kind FROM ts UNION ALL SELECT *, 'A' FROM (SELECT * EXCLUDE (rank) FROM bs) WHERE prog IN (SELECT prog FROM ts)) all_, ta, th, tr, tz, tf))))) GROUP BY prog, n_good, v""", BEST.replace("ts AS (", "ta_ AS (").replace("FROM ts WHERE ftr", "FROM ta_ WHERE ftr").replace("tk AS (", "tk_ AS (").replace("FROM tk ", "FROM tk_ ").replace("tc AS (", "tc_ AS (").replace("FROM tc)", "FROM tc_)") + PEDT + TRIPLE.format(t="pt") + MARKED)
def _(spark, d):
    g = genotypes(spark, d)
    wide = checkpoint(pack(g))
    recorded = checkpoint(triples.statistics(triples.with_masks(recorded_triples(spark, d), wide)))
    found = parents.alternatives(g, cand.candidates(g), phased=False, wide=wide).join(recorded.select("prog"), "prog", "left_semi")
    rows = recorded.withColumn("kind", F.lit("P")).unionByName(found.drop("rank").withColumn("kind", F.lit("A")))
    best = cluster1d.best_pedigrees(cluster1d.categories(rows, cluster1d.category_thresholds(recorded)))
    said = lambda c: F.when(
        F.col(c).isNotNull(), F.concat_ws(" ", *(F.col(f"{c}.{n}") for n in ("kind", "p1", "p2", "category")))
    ).alias(c)
    return best.select("prog", "n_good", "verdict", said("first"), said("second"))


# ---- pedigree graph and side tools ------------------------------------------------------------------------------------------------

DEEP = ", dp AS (SELECT vec_id AS prog, vec_id // 2 AS fpar, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id // 3 END AS mpar FROM embeddings WHERE vec_id > 0)"
EDGES = DEEP + ", ed AS (SELECT fpar AS parent, prog AS child FROM dp UNION SELECT mpar, prog FROM dp WHERE mpar IS NOT NULL)"


def deep_pedigrees(spark, d):
    """A pedigree of many generations: the parents of n are a half and a third of it."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id > 0")
    return rows.select(
        F.col("vec_id").alias("prog"), F.expr("vec_id div 2").alias("fpar"),
        F.expr("case when vec_id % 5 <> 0 then vec_id div 3 end").alias("mpar")
    )


@entry("g1_family_triples", """SELECT 1 AS "case", a.child AS acc, a.parent AS x, b.parent AS y FROM ed a JOIN ed b
  ON a.child = b.child AND a.parent < b.parent
  UNION ALL SELECT 2, a.parent, a.child, b.child FROM ed a JOIN ed b ON a.parent = b.parent AND a.child < b.child UNION ALL SELECT 3, a.child, a.parent, b.child FROM ed a JOIN ed b ON a.child = b.parent""", EDGES)
def _(spark, d):
    return graph.family_triples(graph.edges(deep_pedigrees(spark, d)))


@entry(
    "g2_ancestors", "SELECT id, ancestor, CAST(min(depth) AS INT) AS depth FROM an GROUP BY 1, 2",
    EDGES + ", an AS (SELECT child AS id, parent AS ancestor, 1 AS depth FROM ed UNION SELECT an.id, ed.parent, an.depth + 1 "
        "FROM an JOIN ed ON ed.child = an.ancestor WHERE an.depth < 100)"
)
def _(spark, d):
    return graph.ancestors(checkpoint(graph.edges(deep_pedigrees(spark, d))))


@entry(
    "g2_cycles", "SELECT id FROM an WHERE id = ancestor GROUP BY id",
    EDGES + ", an AS (SELECT child AS id, parent AS ancestor FROM ed UNION SELECT an.id, ed.parent FROM an JOIN ed "
        "ON ed.child = an.ancestor)"
)
def _(spark, d):
    return graph.cycles(graph.edges(deep_pedigrees(spark, d)))


@entry(
    "g2_degrees",
    "SELECT coalesce(u.id, v.id) AS id, coalesce(n_parents, 0) AS n_parents, coalesce(n_offspring, 0) AS n_offspring "
    "FROM (SELECT child AS id, count(*) AS n_parents FROM ed GROUP BY 1) u FULL JOIN (SELECT parent AS id, count(*) AS n_offspring "
    "FROM ed GROUP BY 1) v ON u.id = v.id",
    EDGES
)
def _(spark, d):
    return graph.degrees(graph.edges(deep_pedigrees(spark, d)))


@entry("g2_childless", "SELECT DISTINCT child AS id FROM ed WHERE child NOT IN (SELECT parent FROM ed)", EDGES)
def _(spark, d):
    return graph.childless(graph.edges(deep_pedigrees(spark, d)))


@entry(
    "g3_grandparents", "SELECT a.prog, a.s || b.s AS line, a.p AS parent, b.p AS grandparent FROM lg a JOIN lg b ON b.prog = a.p",
    DEEP + ", lg AS (SELECT prog, 'F' AS s, fpar AS p FROM dp UNION ALL SELECT prog, 'M', mpar FROM dp WHERE mpar IS NOT NULL)"
)
def _(spark, d):
    return graph.grandparents(deep_pedigrees(spark, d)).filter("grandparent is not null")


@entry("g4_random_pedigrees", f"""SELECT r.acc_id AS prog, f.acc_id AS fpar, m.acc_id AS mpar FROM (SELECT *,
  1 + CAST(floor({u('1f', 'acc_id')} * (n - 1)) AS BIGINT) AS s1, CAST(floor({u('1m', 'acc_id')} * (n - 2)) AS BIGINT) AS s2
  FROM rw, nn) r
  JOIN rw f ON f.k = (r.k + s1) % n JOIN rw m ON m.k = (r.k + 1 + (s1 - 1 + 1 + s2) % (n - 1)) % n""", ", rw AS (SELECT acc_id, row_number() OVER (ORDER BY acc_id) - 1 AS k FROM (SELECT DISTINCT acc_id FROM g)), nn AS (SELECT count(*) AS n FROM rw)")
def _(spark, d):
    return graph.random_pedigrees(genotypes(spark, d))


@entry(
    "g5_genome_positions",
    "SELECT marker_id, chrom, pos, CAST(pos + coalesce(o, 0) AS BIGINT) AS cum_pos FROM mp JOIN (SELECT chrom, sum(e) "
    "OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM (SELECT chrom, max(pos) AS e FROM mp "
    "GROUP BY chrom)) USING (chrom)",
    ", mp AS (SELECT DISTINCT marker_id, chrom, 100 * (marker % 16 + 1) AS pos FROM g)"
)
def _(spark, d):
    return graph.genome_positions(
        genotypes(spark, d).select("marker_id", "chrom", F.expr("cast(100 * (marker % 16 + 1) as int)").alias("pos")).distinct()
    )


@entry(
    "g6_noisy_duplicates",
    f"""SELECT acc_id, marker, dosage FROM g UNION ALL SELECT acc_id || '_dup', marker, CASE WHEN {u('1noise', 'acc_id', 'marker')} < 0.05 THEN CAST((dosage + 1 + floor({u('1which', 'acc_id', 'marker')} * 2)) % 3 AS INT) ELSE dosage END FROM g WHERE {u('1', 'acc_id')} < 0.3"""
)
def _(spark, d):
    return graph.duplicates(genotypes(spark, d), 0.3, 0.05).select("acc_id", "marker", "dosage")


@entry("g7_average_phenotypes", """SELECT acc_id, round(avg(value * s), 9) AS value, count(*) AS n FROM ph JOIN (SELECT rep, CASE WHEN regr_slope(value, base) < 0 THEN -1 ELSE 1 END AS s FROM ph JOIN (SELECT acc_id, value AS base FROM ph WHERE rep = 0) USING (acc_id) GROUP BY rep) USING (rep) GROUP BY acc_id""",
       ", ph AS (SELECT vec_id AS acc_id, r AS rep, CAST(embedding[r + 1] AS DOUBLE) * CASE WHEN r % 2 = 1 THEN -1 ELSE 1 "
       "END + CAST(embedding[1] AS DOUBLE) * CASE WHEN r % 2 = 1 THEN -4 ELSE 4 END AS value FROM embeddings, range(4) t(r))")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("acc_id"), F.posexplode(F.slice("embedding", 1, 4)).alias("rep", "x"),
        F.col("embedding")[0].cast("double").alias("e")
    )
    sign = F.when(F.col("rep") % 2 == 1, -1).otherwise(1)
    return graph.average_phenotypes(rows.select("acc_id", "rep", (F.col("x").cast("double") * sign + F.col("e") * sign * 4).alias("value")))


# ---- sources ----------------------------------------------------------------------------------------------------------------------

def vcf_lines(spark, d):
    return checkpoint(vcf.from_genotypes(genotypes(spark, d))).select("value")


@entry(
    "s1_s7_vcf_scan",
    "SELECT acc_id, marker_id, chrom, CAST(100 * (marker + 1) AS BIGINT) AS pos, dosage, CASE WHEN dosage = 1 THEN phase END "
    "AS phase FROM g"
)
def _(spark, d):
    return vcf.parse(vcf_lines(spark, d))


@entry(
    "s4_s5_ds_gp",
    """SELECT CASE WHEN n_chars % 7 = 0 THEN NULL WHEN abs(x - floor(x + 0.5)) <= 0.1 AND floor(x + 0.5) <= 2 THEN CAST(floor(x + 0.5) AS INT) END AS dosage, count(*) AS n FROM (SELECT n_chars, (n_chars % 33) / 10.0 AS x FROM documents) GROUP BY 1"""
)
def _(spark, d):
    token = F.concat(
        F.format_string("%.1f", (F.col("n_chars") % 33) / 10.0),
        F.when(F.col("n_chars") % 7 == 0, ":0.5,0.3,0.2").otherwise(":0.95,0.03,0.02")
    )
    rows = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat_ws(
            "\t", F.lit("1"), F.col("doc_id").cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string")),
            F.lit("A\tG\t.\t.\t.\tDS:GP"), token
        ).alias("value")
    )
    return vcf.parse(rows, ["only"]).groupBy("dosage").agg(F.count("*").alias("n"))


@entry("s6_chrom_pos_ids", "SELECT DISTINCT 'chr' || chrom || '_' || (100 * (marker + 1)) AS marker_id FROM g")
def _(spark, d):
    return vcf.parse(vcf_lines(spark, d), None, vcf.Options(chrom_pos_ids=True)).select("marker_id").distinct()


@entry(
    "s8_s9_vcf_filters",
    "SELECT acc_id, g.marker_id, dosage FROM g JOIN mc ON mc.marker = g.marker WHERE mc.n_missing <= 0.027 * n_acc "
    "AND n_alt >= 0.45 * 2 * (n_acc - mc.n_missing) AND n_alt <= 0.55 * 2 * (n_acc - mc.n_missing) AND acc_id IN (SELECT acc_id "
    "FROM ac WHERE n_missing <= 0.03 * 64)",
    MARK + ACC
)
def _(spark, d):
    rows = vcf.parse(vcf_lines(spark, d))
    good, _ = vcf.split_accessions(rows, 0.03)
    return vcf.marker_filter(rows, 0.027, 0.45).join(
        good.select("acc_id").distinct(), "acc_id", "left_semi"
    ).select("acc_id", "marker_id", "dosage")


TOKEN = "CASE WHEN dosage IS NULL THEN 'X' WHEN dosage = 1 AND phase = 1 THEN '+1' WHEN dosage = 1 AND phase = -1 THEN '-1' ELSE CAST(dosage AS VARCHAR) END"


@entry(
    "s10_s15_matrix_lines",
    f"SELECT acc_id || chr(9) || string_agg({TOKEN}, chr(9) ORDER BY marker) AS value FROM g GROUP BY acc_id UNION ALL "
    f"SELECT 'MARKER' || chr(9) || string_agg(marker_id, chr(9) ORDER BY marker) FROM (SELECT DISTINCT marker, marker_id FROM g) "
    f"UNION ALL SELECT 'CHROMOSOME' || chr(9) || string_agg(CAST(chrom AS VARCHAR), chr(9) ORDER BY marker) "
    f"FROM (SELECT DISTINCT marker, chrom FROM g)"
)
def _(spark, d):
    return matrix.to_lines(genotypes(spark, d)).select("value")


@entry(
    "s11_shuffled_rows",
    "SELECT acc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '7', acc_id)), acc_id) AS place FROM (SELECT DISTINCT acc_id FROM g)"
)
def _(spark, d):
    from pyspark.sql import Window

    lines = matrix.to_lines(genotypes(spark, d), 7).filter("k >= '2'")
    return lines.select(F.split("value", "\t")[0].alias("acc_id"), F.row_number().over(Window.orderBy("k")).cast("bigint").alias("place"))


@entry("s12_s13_matrix_scan", "SELECT acc_id, marker, marker_id, chrom, dosage, CASE WHEN dosage = 1 THEN phase END AS phase FROM g")
def _(spark, d):
    return matrix.parse(checkpoint(matrix.to_lines(genotypes(spark, d))).select("value"))


@entry("s14_reference_union", "SELECT acc_id IN (SELECT mpar FROM ped) AS is_ref, count(DISTINCT acc_id) AS n FROM g GROUP BY 1")
def _(spark, d):
    g, p = genotypes(spark, d), pedigrees(spark, d).select(F.col("mpar").alias("acc_id")).distinct()
    both = matrix.with_reference(g.join(p, "acc_id", "left_semi"), g.join(p, "acc_id", "left_anti"))
    return both.groupBy("is_ref").agg(F.count_distinct("acc_id").alias("n"))


@entry("s16_pedigree_scan", "SELECT prog, fpar, mpar FROM ped")
def _(spark, d):
    return tables.known_pedigrees(tables.pedigree_records(text(pedigrees(spark, d), "prog", "fpar", "mpar")), genotypes(spark, d))


@entry("s17_role_scan", "SELECT acc_id, role FROM ro", ACC + ROLES)
def _(spark, d):
    return tables.roles(text(cand.roles_by_heterozygosity(genotypes(spark, d), 0.3, 1.3, 50), "acc_id", "role"))


@entry("s18_sniff", "SELECT 'vcf' AS first, 'matrix' AS second, 'error' AS third, 'vcf' AS fourth")
def _(spark, d):
    def kind(df: DataFrame) -> str:
        try:
            return matrix.sniff(df)
        except ValueError:
            return "error"

    files = vcf_lines(spark, d), matrix.to_lines(genotypes(spark, d)), spark.read.parquet(f"{d}/benchmark.parquet").select(
        F.col("text").alias("value")
    )
    # lines of both kinds: the #CHROM line decides
    found = [kind(x) for x in (*files, files[1].select("value").unionByName(files[0].select("value")))]
    return one(spark, dict(enumerate(found)), "first string, second string, third string, fourth string")


@entry(
    "s19_distance_matrix",
    """SELECT 'v' || a.vec_id AS id1, 'v' || (c - 1) AS id2, CAST(a.embedding[c] AS DOUBLE) AS d FROM embeddings a, range(1, 65) t(c) WHERE c - 1 < a.vec_id AND CAST(a.embedding[c] AS DOUBLE) <= -0.2"""
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("line"), F.transform("embedding", lambda x: x.cast("double")).alias("values")
    )
    return tables.distance_matrix(rows, rows.select("line", F.concat(F.lit("v"), F.col("line").cast("string")).alias("id")), -0.2)


@entry(
    "s20_ped",
    "SELECT acc_id || ' ' || acc_id || ' 0 0 0 -9 ' || string_agg(CASE dosage WHEN 0 THEN 'L L' WHEN 1 THEN 'L H' "
    "WHEN 2 THEN 'H H' ELSE '0 0' END, ' ' ORDER BY marker) AS value FROM g GROUP BY acc_id"
)
def _(spark, d):
    return tables.to_ped(genotypes(spark, d)).select("value")


@entry(
    "s20_map",
    "SELECT DISTINCT chrom, 'S' || chrom || '_' || (marker + 5) AS marker_id, 0 AS cm, CAST(marker + 5 AS BIGINT) AS pos FROM g"
)
def _(spark, d):
    return tables.to_map(
        genotypes(spark, d).select(
            "chrom",
            F.concat(F.lit("S"), F.col("chrom").cast("string"), F.lit("_"), (F.col("marker") + 5).cast("string")).alias("marker_id")
        ).distinct()
    )


@entry("s21_vcf_subset", "SELECT acc_id, marker_id, dosage FROM g WHERE acc_id IN (SELECT mpar FROM ped)")
def _(spark, d):
    keep = pedigrees(spark, d).select(F.col("mpar").alias("acc_id"))
    lines = checkpoint(vcf.subset(vcf_lines(spark, d), keep))
    return vcf.parse(lines).select("acc_id", "marker_id", "dosage")


@entry("s22_check_format", "SELECT 'GT:GP' AS format, 'ok' AS kind, count(*) AS n FROM g")
def _(spark, d):
    return vcf.check_format(vcf_lines(spark, d))


# a line per document whose token, by the number's remainder, is sound or broken in one way
@entry(
    "s22_bad_tokens",
    """SELECT 'GT:DS:GP' AS format, kind, count(*) AS n FROM (SELECT CASE n_chars % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'colons' WHEN 2 THEN 'GT' WHEN 3 THEN 'DS' WHEN 4 THEN 'GP' WHEN 5 THEN 'colons' WHEN 6 THEN 'GT' WHEN 7 THEN 'ok' ELSE 'DS' END AS kind FROM documents WHERE n_chars IS NOT NULL) GROUP BY kind"""
)
def _(spark, d):
    tokens = [
        "0/1:1.0:0,1,0", "0/1:1.0", "0-1:1.0:0,1,0", "0/1:x:0,1,0", "0/1:1:0;1;0", "0/1:1:0,1,0:7", ":1:0,1,0", "1|1:.5:1e-3,0.9,0",
        "./.::0,1,0"
    ]
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("n_chars is not null")
    token = F.element_at(F.array(*map(F.lit, tokens)), (F.col("n_chars") % 9 + 1).cast("int"))
    fields = ["1", "5", ".", "A", "G", ".", ".", ".", "GT:DS:GP"]
    return vcf.check_format(docs.select(F.concat_ws("\t", *map(F.lit, fields), token).alias("value")))


@entry(
    "s23_phased_vcf",
    "SELECT acc_id, count(*) FILTER (phase = 1 AND dosage = 1) AS plus, count(*) FILTER (phase = -1 AND dosage = 1) AS minus "
    "FROM g GROUP BY acc_id"
)
def _(spark, d):
    return vcf.parse(vcf_lines(spark, d), None, vcf.Options(fields=("GT",))).groupBy("acc_id").agg(
        F.count_if(F.col("phase") == 1).alias("plus"), F.count_if(F.col("phase") == -1).alias("minus")
    )


@entry(
    "s24_ad_dosage",
    """SELECT CASE WHEN r + a >= 5 THEN CAST(floor(2 * a / CAST(r + a AS DOUBLE) + 0.5) AS INT) END AS dosage, count(*) AS n FROM (SELECT n_chars % 11 AS r, n_chars % 7 AS a FROM documents) GROUP BY 1"""
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat_ws(
            "\t", F.lit("1"), F.col("doc_id").cast("string"), F.lit("."), F.lit("A\tG\t.\t.\t.\tAD"),
            F.concat((F.col("n_chars") % 11).cast("string"), F.lit(","), (F.col("n_chars") % 7).cast("string"))
        ).alias("value")
    )
    return vcf.parse(rows, ["only"], vcf.Options(fields=("GT", "DS", "AD"))).groupBy("dosage").agg(F.count("*").alias("n"))


@entry(
    "s25_ds_only",
    "SELECT CASE WHEN abs(x - floor(x + 0.5)) <= 0.3 AND floor(x + 0.5) <= 2 THEN CAST(floor(x + 0.5) AS INT) END AS dosage, "
    "count(*) AS n FROM (SELECT (n_chars % 33) / 10.0 AS x FROM documents) GROUP BY 1"
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat_ws(
            "\t", F.lit("1"), F.col("doc_id").cast("string"), F.lit("."), F.lit("A\tG\t.\t.\t.\tDS"),
            F.format_string("%.1f", (F.col("n_chars") % 33) / 10.0)
        ).alias("value")
    )
    return vcf.parse(rows, ["only"], vcf.Options(fields=("DS",), delta=0.3)).groupBy("dosage").agg(F.count("*").alias("n"))


# ---- whole pipelines --------------------------------------------------------------------------------------------------------------

def whole_run_sql() -> str:
    """The level 0 check of q5_q6_level0 over the accessions and pedigrees that u1_u2 and u4_u7 leave at 0.035; inner names hide outer
    ones."""
    check = ENTRIES["q5_q6_level0"][1].removeprefix(PREFIX)
    return f"SELECT * FROM (WITH g AS (SELECT * FROM gu), ped AS (SELECT * FROM pu){check})"


UNIQUE = threshold_clusters(0.035) + UPED + """, gu AS (SELECT * FROM g WHERE acc_id NOT IN (SELECT id FROM rp WHERE id <> rep)),
pu AS (SELECT prog, fpar, mpar FROM (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY CAST(fpar IS NULL AS INT) + CAST(mpar IS NULL AS INT), line) AS k FROM ur) WHERE k = 1)"""


@entry("w1_vcf_to_parents", whole_run_sql(), UNIQUE)
def _(spark, d):
    from genoquery.plans.pipeline import vcf_to_parents

    return vcf_to_parents(vcf_lines(spark, d), pedigrees(spark, d))["parents"]


FOUND = "(SELECT t FROM th)"
FINDER_SQL = (
    LEFT.replace("count(*) OVER () AS n FROM pr", f"count(*) OVER () AS n FROM pr WHERE agmr <= {NEAR}")
    + ", th AS (SELECT coalesce((SELECT h FROM gq, tq WHERE gq.place = tq.place - 16), (SELECT h FROM bq), 0.035) AS t)"
    + threshold_clusters(FOUND).removeprefix(PAIRS)
)


@entry("w2_duplicate_finder", cluster_sql(FOUND), FINDER_SQL)
def _(spark, d):
    from genoquery.plans.pipeline import find_duplicates

    return find_duplicates(vcf_lines(spark, d))["clusters"]


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ENTRIES.items() if s}
