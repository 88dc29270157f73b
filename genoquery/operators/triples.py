"""Statistics of triples (first parent i, second parent j, progeny k) from bit masks, in the JVM.

A triple has struct columns i, j, k with m0, m1, m2 (null for an unknown parent). "Known" means known in all three unless
said otherwise. Counts stay integers; ratios are null where undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from genoquery.functions.masks import NAMES, bits
from genoquery.functions.ratios import ratio, tally
from genoquery.operators.filters import marker_counts


def with_masks(triples: DataFrame, wide: DataFrame) -> DataFrame:
    """triples (prog, p1, p2) with the masks of all three; parents that are null or have no genotypes stay null."""
    one = wide.select("acc_id", F.struct(*NAMES).alias("x"))
    for c, name, how in (("prog", "k", "inner"), ("p1", "i", "left"), ("p2", "j", "left")):
        triples = triples.join(one.select(F.col("acc_id").alias(c), F.col("x").alias(name)), c, how)
    return triples


def _any(*words: Column) -> Column:
    out = words[0]
    for w in words[1:]:
        out = out.bitwiseOR(w)
    return out


def _all(*words: Column) -> Column:
    out = words[0]
    for w in words[1:]:
        out = out.bitwiseAND(w)
    return out


def _conditions(get) -> dict[str, Column]:
    i0, i1, i2, j0, j1, j2, k0, k1, k2 = (get(f"{s}.m{d}") for s in "ijk" for d in range(3))
    known_i, known_j, known_k = _any(i0, i1, i2), _any(j0, j1, j2), _any(k0, k1, k2)
    known = _all(known_i, known_j, known_k)
    parents_hom = _any(_all(i0, j0), _all(i2, j2))
    het = _any(i1, j1)
    return {
        "n_known": known,
        "n_differ": _any(_all(i0, _any(j1, j2)), _all(i1, _any(j0, j2)), _all(i2, _any(j0, j1))).bitwiseAND(known),
        "n_opposed": _any(_all(k2, _any(i0, j0)), _all(k0, _any(i2, j2))).bitwiseAND(known),
        "n_hom_het": _all(parents_hom, k1),
        "n_hom_other": _any(_all(i0, j0, k2), _all(i2, j2, k0)),
        "n_hom": _all(parents_hom, known),
        "n_11": _all(i1, j1, known),
        "n_11_1": _all(i1, j1, k1),
        "n_het": _all(het, known),
        "n_het_1": _all(het, known, k1),
    }


def _pair_conditions(get, par: str) -> dict[str, Column]:
    p0, p1, p2, k0, k1, k2 = (get(f"{s}.m{d}") for s in (par, "k") for d in range(3))
    return {"n02": _any(_all(p0, k2), _all(p2, k0)), "n00_22": _any(_all(p0, k0), _all(p2, k2)), "n_hom_1": _all(_any(p0, p2), k1)}


def statistics(triples: DataFrame, means: dict[str, float] | None = None, denominators: bool = False) -> DataFrame:
    """T1 to T7 of triples with masks: n_good, agmr12, hgmr1, r1, hgmr2, r2, ftr, ftr_n, z, h, hhr.

    ftr counts opposed homozygotes, heterozygotes of equal homozygous parents, and once more the opposite homozygote of such
    parents. With one parent (T6), R has the opposite homozygotes in both its parts; the statistics of two parents are null.
    `means` divide hgmr, r, ftr and z (T7). With `denominators`, agmr12_d, hgmr1_d, r1_d, hgmr2_d, r2_d, ftr_d and z_d are there too (null
    where a parent that the statistic needs is unknown).
    """
    both = F.col("i").isNotNull() & F.col("j").isNotNull()
    names = list(_conditions(lambda n: F.lit(0).cast("bigint")))
    made = [F.when(both, bits(F.col("k.m0"), lambda get, n=n: _conditions(get)[n])).alias(n) for n in names]
    for par, t in (("i", 1), ("j", 2)):
        for n in ("n02", "n00_22", "n_hom_1"):
            made.append(
                F.when(
                    F.col(par).isNotNull(), bits(F.col("k.m0"), lambda get, n=n, par=par: _pair_conditions(get, par)[n])
                ).alias(f"{n}_{t}")
            )
    made.append(both.alias("__both"))
    c = F.col
    mean = {"hgmr": 1.0, "r": 1.0, "ftr": 1.0, "z": 1.0} | (means or {})
    out = [c("n_known").alias("n_good"), ratio("n_differ", "n_known").alias("agmr12")]
    for t in (1, 2):
        missed, same, het = c(f"n02_{t}"), c(f"n00_22_{t}"), c(f"n_hom_1_{t}")
        out += [
            (ratio(missed, missed + same) / mean["hgmr"]).alias(f"hgmr{t}"),
            (F.when(c("__both"), ratio(het, het + same)).otherwise(ratio(missed + het, missed + het + same)) / mean["r"]).alias(f"r{t}")
        ]
        if denominators:
            known = F.when(c("__both"), het + same).otherwise(missed + het + same)
            out += [(missed + same).alias(f"hgmr{t}_d"), known.alias(f"r{t}_d")]
    if denominators:
        out += [c("n_known").alias("agmr12_d"), c("n_known").alias("ftr_d"), c("n_hom").alias("z_d")]
    forbidden = c("n_opposed") + c("n_hom_het") + c("n_hom_other")
    out += [
        (ratio(forbidden, c("n_known")) / mean["ftr"]).alias("ftr"), forbidden.alias("ftr_n"),
        (ratio("n_hom_het", "n_hom") / mean["z"]).alias("z"), ratio("n_11_1", "n_11").alias("h"), ratio("n_het_1", "n_het").alias("hhr")
    ]
    keep = [x for x in triples.columns if x not in "ijk"]
    return triples.select(*keep, *made).select(*keep, *out)


def long_triples(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """prog, p1, p2, marker, i, j, k of markers known in all three."""
    own = genotypes.filter("dosage is not null").select("acc_id", "marker", "dosage")
    rows = triples.select("prog", "p1", "p2").join(own.withColumnsRenamed({"acc_id": "prog", "dosage": "k"}), "prog")
    for p, name in (("p1", "i"), ("p2", "j")):
        rows = rows.join(own.select(F.col("acc_id").alias(p), "marker", F.col("dosage").alias(name)), [p, "marker"])
    return rows


def state_counts(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """How often each of the 27 states of a triple occurs, with its weight in FTR and whether Mendel forbids it."""
    rows = long_triples(genotypes, triples).groupBy("i", "j", "k").agg(F.count("*").alias("n"))
    opposed = F.expr("(k = 2 and (i = 0 or j = 0)) or (k = 0 and (i = 2 or j = 2))")
    hom = F.expr("i = j and i <> 1")
    weight = opposed.cast("int") + (hom & (F.col("k") == 1)).cast("int") + (hom & opposed).cast("int")
    return rows.select("i", "j", "k", "n", weight.alias("weight"), (weight > 0).alias("forbidden"))


def shares(genotypes: DataFrame) -> DataFrame:
    known = F.col("n0") + F.col("n1") + F.col("n2")
    return marker_counts(genotypes).select(
        "marker", *(ratio(F.col(f"n{d}"), known).alias(f"f{d}") for d in (0, 1, 2)), ratio("n_alt", 2 * known).alias("q")
    )


_FORBIDDEN = "(i = 0 and j = 0 and k > 0) or (i = 2 and j = 2 and k < 2) or (i + j = 1 and k = 2) or (i + j = 3 and k = 0) or (i + j = 2 and i <> j and k <> 1)"


def expected_forbidden(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """Forbidden triples seen over those expected from the progeny's marker frequencies (xftr), and over all known markers
    (rate)."""
    rows = long_triples(genotypes, triples).join(shares(genotypes), "marker")
    chance = F.expr(
        "case when i = 0 and j = 0 then f1 + f2 when i = 2 and j = 2 then f0 + f1 when i + j = 1 then f2 when i + j = 3 then f0 "
        "when i <> j then f0 + f2 else 0.0 end"
    )
    counted = rows.groupBy("prog", "p1", "p2").agg(tally(_FORBIDDEN).alias("seen"), F.sum(chance).alias("e"), F.count("*").alias("n"))
    return counted.select(
        "prog", "p1", "p2", "seen", F.round("e", 6).alias("expected"),
        F.round(F.when(F.col("e") > 0, F.col("seen") / F.nullif("e", F.lit(0.0))), 6).alias("xftr"), ratio("seen", "n").alias("rate")
    )


def mixed_rate(rows: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Alpha * xftr + (1 - alpha) * rate."""
    return rows.withColumn("xxftr", F.round(alpha * F.col("xftr") + (1 - alpha) * F.col("rate"), 6))


def pedigree_class(
    rows: DataFrame, max_agmr: float = 0.04, max_hgmr: float = 0.05, max_r: float = 0.15, max_ftr: float = 0.05
) -> DataFrame:
    """What a pedigree's statistics say: self, biparental, one or both parents wrong, or unclear if one is undefined."""
    good1, good2 = F.col("hgmr1") <= max_hgmr, F.col("hgmr2") <= max_hgmr
    verdict = F.when(F.col("ftr").isNull() | F.col("agmr12").isNull(), "unclear").when(
        (F.col("agmr12") <= max_agmr) & good1 & (F.col("r1") <= max_r), "self"
    ).when((F.col("ftr") <= max_ftr) & good1 & good2, "biparental").when(good1 | good2, "one").otherwise("none")
    return rows.withColumn("class", verdict)


def pair_rows(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """prog, par, marker, k, i of markers known in both."""
    own = genotypes.filter("dosage is not null").select("acc_id", "marker", "dosage")
    return pairs.select("prog", "par").join(own.withColumnsRenamed({"acc_id": "prog", "dosage": "k"}), "prog").join(
        own.select(F.col("acc_id").alias("par"), "marker", F.col("dosage").alias("i")), ["par", "marker"]
    )


def one_parent(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hgmr and both forms of R of pairs (prog, par), from masks."""
    from genoquery.operators.candidates import pair_tallies, paired

    rows = pair_tallies(
        paired(genotypes, pairs), **{n: (lambda get, known, n=n: _pair_conditions(get, "i")[n]) for n in ("n02", "n00_22", "n_hom_1")}
    )
    missed, same, het = F.col("n02"), F.col("n00_22"), F.col("n_hom_1")
    return rows.select(
        "prog", "par", ratio(missed, missed + same).alias("hgmr"), ratio(missed + het, missed + het + same).alias("r_all"),
        ratio(het, het + same).alias("r")
    )


def direction(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Log likelihoods of the progeny's dosages given the parent's, of the reverse, and of chance, with an error rate of
    0.01; and the crosswise counts n01, n10, n12, n21."""
    rows = pair_rows(genotypes, pairs).join(shares(genotypes).select("marker", "q"), "marker").filter("q > 0 and q < 1")

    def given(parent: str, child: str) -> Column:
        # the chance of the child's dosage if one allele is the parent's and the other is drawn at frequency q
        p = F.expr(
            f"case {parent} when 0 then (case {child} when 0 then 1 - q when 1 then q else 0.0 end) when 1 then (case {child} when "
            f"0 then (1 - q) / 2 when 1 then 0.5 else q / 2 end) else (case {child} when 0 then 0.0 when 1 then 1 - q else q end) "
            f"end"
        )
        return F.log(0.99 * p + 0.01 / 3)

    chance = F.expr("case k when 0 then (1 - q) * (1 - q) when 1 then 2 * q * (1 - q) else q * q end")
    return rows.groupBy("prog", "par").agg(
        F.round(F.sum(given("i", "k")), 6).alias("log_par_prog"), F.round(F.sum(given("k", "i")), 6).alias("log_prog_par"),
        F.round(F.sum(F.log(0.99 * chance + 0.01 / 3)), 6).alias("log_chance"),
        *(tally(f"i = {a} and k = {b}").alias(f"n{a}{b}") for a, b in ((0, 1), (1, 0), (1, 2), (2, 1)))
    )
