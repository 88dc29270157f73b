"""Histograms of columns of numbers, and other summaries of text tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from genoquery.operators.prefix import running

# The bin widths that are tried, times a power of ten.
WIDTHS = (100, 125, 200, 250, 400, 500, 800)


def column_algebra(spec: str, at) -> list[Column]:
    """A10: the columns that a spec stands for; at(i) is column i (from 1) as a double. `5+8-12` is a signed sum, `3u8` two series, `a/b`
    and `a*b` a ratio and a product, `log13` a base-10 logarithm (of 0: minus infinity, an underflow)."""
    import re

    if "u" in spec:
        return [c for part in spec.split("u") for c in column_algebra(part, at)]
    if spec.startswith("log"):
        x = at(int(spec[3:]))
        return [F.when(x > 0, F.log10(x)).when(x == 0, F.lit(-math.inf))]
    if "/" in spec or "*" in spec:
        a, sign, b = re.fullmatch(r"(\d+)([/*])(\d+)", spec).groups()
        return [at(int(a)) / F.nullif(at(int(b)), F.lit(0.0)) if sign == "/" else at(int(a)) * at(int(b))]
    terms = re.findall(r"([+-]?)(\d+)", spec)
    total = None
    for sign, i in terms:
        x = -at(int(i)) if sign == "-" else at(int(i))
        total = x if total is None else total + x
    return [total]


@dataclass(frozen=True)
class Bins:
    """A range and a bin width."""

    lo: float
    hi: float
    width: float

    @property
    def count(self) -> int:
        return max(1, round((self.hi - self.lo) / self.width))

    def expanded(self, factor: float) -> Bins:
        middle, half = (self.lo + self.hi) / 2, (self.hi - self.lo) * factor / 2
        down, up = math.floor((middle - half - self.lo) / self.width + 1e-9), math.ceil((middle + half - self.lo) / self.width - 1e-9)
        return replace(self, lo=self.lo + down * self.width, hi=self.lo + up * self.width)

    def notched(self, notches: int) -> Bins:
        """Coarser (positive) or finer bins by steps of WIDTHS."""
        power = math.floor(math.log10(self.width / WIDTHS[0]) + 1e-9)
        at = min(range(len(WIDTHS)), key=lambda i: abs(WIDTHS[i] * 10.0**power - self.width)) + notches
        return replace(self, width=WIDTHS[at % len(WIDTHS)] * 10.0 ** (power + at // len(WIDTHS)))

    def limited(self, lo: float | None = None, hi: float | None = None) -> Bins:
        return replace(self, lo=self.lo if lo is None else lo, hi=self.hi if hi is None else hi)


def nice_width(x: float) -> float:
    """The largest of WIDTHS times a power of ten that is at most x."""
    power = math.floor(math.log10(x / WIDTHS[0]) + 1e-12)
    return max(w * 10.0**power for w in WIDTHS if w * 10.0**power <= x * (1 + 1e-12))


def auto_bins(values: DataFrame, column: str = "x") -> Bins:
    """From the 5 to 95 % range over the cube root of the count; whole numbers have a width of 1 at least and edges at halves."""
    x = F.col(column)
    finite = values.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    row = finite.agg(
        F.percentile(x, F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.count("*").alias("n"), F.min(x).alias("lo"),
        F.max(x).alias("hi"), F.bool_and(x == F.floor(x)).alias("whole")
    ).first()
    if not row["n"]:
        return Bins(0.0, 1.0, 1.0)
    half = (row["p"][1] - row["p"][0]) / 2 or max(abs(row["hi"]), 1.0) / 2
    width = nice_width(half / row["n"] ** (1 / 3))
    if row["whole"]:
        width = max(1.0, float(math.floor(width)))
        lo = math.floor(row["lo"]) - 0.5
        return Bins(lo, lo + width * math.ceil((row["hi"] - lo) / width + 1e-9), width)
    lo = width * math.floor(row["lo"] / width)
    return Bins(lo, lo + width * (math.floor((row["hi"] - lo) / width) + 1), width)


def histogram(values: DataFrame, bins: Bins, column: str = "x", series: str | None = None) -> DataFrame:
    """Per series and bin: count and cumulative count; bin -1 is the underflow (x < lo), bin `count` the overflow (x >= hi).
    Undefined values are left out."""
    x = F.col(column)
    place = F.when(x < bins.lo, -1).when(x >= bins.hi, bins.count).otherwise(F.floor((x - bins.lo) / bins.width)).cast("int")
    keys = [series] if series else []
    counted = values.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))  # one row per bin
    return counted.withColumn("cumulative", upto).withColumn("lo", F.round(F.lit(bins.lo) + F.col("bin") * bins.width, 9))


def summary(values: DataFrame, column: str = "x", series: str | None = None) -> DataFrame:
    """Count, mean, population standard deviation, standard error, median."""
    x = F.col(column)
    rows = values.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*([series] if series else []))
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"),
        F.round(F.stddev_pop(x) / F.sqrt(F.count("*")), 6).alias("se"), F.round(F.percentile(x, 0.5), 6).alias("median")
    )


def fields_per_line(lines: DataFrame, separator: str = r"\s+") -> DataFrame:
    """For each number of fields, the lines that have it and the first of them in order; a null line has none."""
    n = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim("value"), separator)))
    return lines.groupBy(n.cast("int").alias("fields")).agg(F.count("*").alias("n"), F.min("value").alias("sample"))


def compare_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct values only on the left, on both sides, only on the right."""
    a, b = left.select("value").distinct().withColumn("l", F.lit(1)), right.select("value").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "value", "full")
    return both.agg(
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"),
        F.count_if(F.col("l").isNull()).alias("right_only")
    )


def compare_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values of two tables (id1, id2, d) by unordered pair; null where a side lacks it. Of repeated pairs the smallest value
    counts."""
    side = lambda df, n: df.groupBy(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).agg(F.min("d").alias(n))
    return side(left, "d1").join(side(right, "d2"), ["a", "b"], "full")


def nearest(pairs: DataFrame) -> DataFrame:
    """Each id1's smallest distance and the id2 it's to (the smaller id of equal ones)."""
    return pairs.groupBy("id1").agg(F.min(F.struct("d", "id2")).alias("x")).select(
        "id1", F.col("x.d").alias("d"), F.col("x.id2").alias("id2")
    )


def error_curve(rows: DataFrame, score: str, is_null: str, order: str) -> DataFrame:
    """Rows by falling score (then `order`), with running counts of null and other ids. Counts per score are summed first; rows
    without a score are left out."""
    per = rows.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(is_null)).alias("f"), F.count_if(~F.col(is_null)).alias("t")
    )
    return running(per, score, {"n_null": F.col("f"), "n_other": F.col("t")}, descending=True).drop("f", "t")
