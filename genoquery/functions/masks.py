"""Dosages as bit masks: three arrays of 64-bit words per accession (dosage 0, 1, 2), a marker's bit in at most one of them.

A missing dosage has no bit at all, so unused bits of the last word never count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

NAMES = ("m0", "m1", "m2")


def pack(genotypes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per accession: acc_id, m0, m1, m2, n_missing and the columns of `keep` (constant within an accession). genotypes: acc_id,
    marker (from 0, dense), dosage.

    Two aggregations on the same key prefix: words are combined on the map side, so a row per accession and word is shuffled.
    """
    words = genotypes.select(
        "acc_id", *keep, F.expr("marker div 64").alias("w"), F.expr("shiftleft(1L, cast(marker % 64 as int))").alias("bit"), "dosage"
    )
    masks = [
        F.coalesce(F.bit_or(F.when(F.col("dosage") == d, F.col("bit"))), F.lit(0).cast("bigint")).alias(n) for d, n in enumerate(NAMES)
    ]
    by_word = words.groupBy("acc_id", *keep, "w").agg(*masks, F.count_if(F.col("dosage").isNull()).alias("missing"))
    width = F.max("w").alias("top")
    rows = by_word.groupBy("acc_id", *keep).agg(
        F.sort_array(F.collect_list(F.struct("w", *NAMES))).alias("s"), F.sum("missing").cast("bigint").alias("n_missing"), width
    )

    def field(n: str) -> Column:
        # a word without any row (markers with gaps) is 0
        return F.when(F.size("s") == F.col("top") + 1, F.transform("s", lambda x: x[n])).otherwise(
            F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("top")), lambda i: F.coalesce(F.get(F.filter("s", lambda x: x["w"] == i), F.lit(0))[n], F.lit(0).cast("bigint")))
        ).alias(n)

    fields = [field(n) for n in NAMES]
    return rows.select("acc_id", *keep, *fields, "n_missing")


def bits(first: str, condition: Callable[[Callable[[str], Column]], Column]) -> Column:
    """The number of markers that meet a condition. It's given as an expression over words: get('a.m0') is the word of that column;
    `first` is a column with the number of words."""
    return F.aggregate(
        F.sequence(F.lit(1), F.size(first)), F.lit(0).cast("bigint"),
        lambda total, i: total + F.bit_count(condition(lambda name: F.element_at(F.col(name), i))).cast("bigint")
    )
