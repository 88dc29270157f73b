"""Crossovers and phase along chromosomes. Windows run over eligible markers only, per chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoquery.functions.ratios import ratio, tally


def _met(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """prog, par, chrom, marker, k (progeny's dosage), kp (its phase), ph (the parent's phase) at phased heterozygous markers of the
    parent with a known dosage in the progeny."""
    parent = genotypes.filter("dosage = 1 and phase is not null").select(
        F.col("acc_id").alias("par"), "marker", "chrom", F.col("phase").alias("ph")
    )
    child = genotypes.filter("dosage is not null").select(
        F.col("acc_id").alias("prog"), "marker", F.col("dosage").alias("k"), F.col("phase").alias("kp")
    )
    return pairs.select("prog", "par").filter("par is not null").distinct().join(parent, "par").join(child, ["prog", "marker"])


def crossovers(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (prog, par) with an eligible marker, x (changes of the inherited parental chromosome between neighbouring eligible markers
    of a chromosome) and n_het (eligible markers: the parent is a phased heterozygote, the progeny homozygous)."""
    along = Window.partitionBy("prog", "par", "chrom").orderBy("marker")
    rows = _met(genotypes, pairs).filter("k <> 1").withColumn("side", F.expr("(k = 2) <> (ph = -1)"))
    return rows.withColumn("before", F.lag("side").over(along)).groupBy("prog", "par").agg(
        tally("side <> before").alias("x"), F.count("*").alias("n_het")
    )


def parent_crossovers(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples (prog, p1, p2, ...) with x_f, nhet_f, x_m, nhet_m and acc, the larger number of crossovers; null for an unknown parent,
    0 without an eligible marker."""
    asked = triples.select("prog", F.explode(F.array("p1", "p2")).alias("par"))
    found = crossovers(genotypes, asked)
    for p, s in (("p1", "f"), ("p2", "m")):
        own = found.select("prog", F.col("par").alias(p), F.col("x").alias(f"x_{s}"), F.col("n_het").alias(f"nhet_{s}"))
        triples = triples.join(own, ["prog", p], "left")
        for c in (f"x_{s}", f"nhet_{s}"):
            triples = triples.withColumn(c, F.when(F.col(p).isNotNull(), F.coalesce(c, F.lit(0))))
    return triples.withColumn("acc", F.greatest("x_f", "x_m"))


def chromosome_hypotheses(genotypes: DataFrame, pairs: DataFrame, drop_single: bool = False) -> DataFrame:
    """Per (prog, par, chrom): xa and xb (changes if the progeny's first or second chromosome is the parent's; heterozygous
    progeny need a phase), x_min, x_max, n_het, n02 and n_hom for hgmr. With drop_single, a change that the next eligible marker takes
    back isn't counted (nor is that one)."""
    side = lambda plus: F.expr(
        f"case when k = 0 then ph = -1 when k = 2 then ph = 1 when kp = {plus} then ph = -1 when kp = {-plus} then ph = 1 end"
    )
    along = Window.partitionBy("prog", "par", "chrom").orderBy("marker")
    rows = _met(genotypes, pairs).filter("k <> 1 or kp is not null").withColumn("a", side(1)).withColumn("b", side(-1))
    for c in "ab":
        rows = rows.withColumn(f"{c}_prev", F.lag(c).over(along)).withColumn(f"{c}_next", F.lead(c).over(along)).withColumn(
            f"{c}_prev2", F.lag(c, 2).over(along)
        )
    made = []
    for c in "ab":
        changed = F.col(c) != F.col(f"{c}_prev")
        if drop_single:
            changed &= ~F.coalesce(F.col(f"{c}_next") != F.col(c), F.lit(False)) & ~F.coalesce(
                (F.col(f"{c}_prev2") == F.col(c)), F.lit(False)
            )
        made.append(F.count_if(changed).alias(f"x{c}"))
    counted = rows.groupBy("prog", "par", "chrom").agg(*made, F.count("*").alias("n_het"))
    known = genotypes.filter("dosage is not null").select("acc_id", "marker", "chrom", "dosage")
    both = pairs.select("prog", "par").filter("par is not null").distinct().join(known.withColumnsRenamed({"acc_id": "prog", "dosage": "k"}), "prog").join(
        known.select(F.col("acc_id").alias("par"), "marker", F.col("dosage").alias("i")), ["par", "marker"]
    )
    hom = both.groupBy("prog", "par", "chrom").agg(tally("abs(i - k) = 2").alias("n02"), tally("i <> 1 and k <> 1").alias("n_hom"))
    rows = hom.join(counted, ["prog", "par", "chrom"], "left").na.fill(0, ["xa", "xb", "n_het"])
    return rows.select(
        "prog", "par", "chrom", "xa", "xb", F.least("xa", "xb").alias("x_min"), F.greatest("xa", "xb").alias("x_max"), "n_het", "n02",
        "n_hom"
    )


def pair_totals(by_chrom: DataFrame) -> DataFrame:
    """Sums over chromosomes, each pair beside its reverse (null where that isn't there)."""
    total = by_chrom.groupBy("prog", "par").agg(*(F.sum(c).alias(c) for c in ("x_min", "x_max", "n_het")))
    total = total.withColumn("rate", ratio("x_min", "n_het"))
    back = total.select(
        F.col("prog").alias("par"), F.col("par").alias("prog"), *(F.col(c).alias(f"rev_{c}") for c in ("x_min", "x_max", "n_het", "rate"))
    )
    return total.join(back, ["prog", "par"], "left")


def triple_quality(by_chrom: DataFrame, triples: DataFrame, bad: int = 3) -> DataFrame:
    """Per triple: x_min of either parent, the least number of changes with one parent on each of the progeny's chromosomes (per
    chromosome the better way), and the chromosomes that need more than `bad`."""
    for p, s in (("p1", "1"), ("p2", "2")):
        own = by_chrom.select(
            "prog", F.col("par").alias(p), "chrom", F.col("xa").alias(f"a{s}"), F.col("xb").alias(f"b{s}"),
            F.col("x_min").alias(f"min{s}")
        )
        triples = triples.join(own, ["prog", p, "chrom"] if s == "2" else ["prog", p])
    best = F.least(F.col("a1") + F.col("b2"), F.col("b1") + F.col("a2"))
    return triples.groupBy("prog", "p1", "p2").agg(
        F.sum("min1").alias("min1"), F.sum("min2").alias("min2"), F.sum(best).alias("consistent"), F.count_if(best > bad).alias("n_bad")
    )


def annotate_pairs(pairs: DataFrame, pedigrees: DataFrame) -> DataFrame:
    """Pairs (prog, par, ...) with the recorded parent's place: F, M, FM or null."""
    rows = pairs.join(pedigrees.select("prog", "fpar", "mpar"), "prog", "left")
    f, m = F.coalesce(F.col("par") == F.col("fpar"), F.lit(False)), F.coalesce(F.col("par") == F.col("mpar"), F.lit(False))
    return rows.withColumn("recorded", F.when(f & m, "FM").when(f, "F").when(m, "M")).drop("fpar", "mpar")


def _known_triples(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """prog, p1, p2, chrom, marker, k, kp (progeny's dosage and phase), i, ip, j, jp (those of its parents) at markers known in all
    three."""
    own = genotypes.filter("dosage is not null").select("acc_id", "marker", "chrom", "dosage", "phase")
    rows = triples.select("prog", "p1", "p2").filter("p1 is not null and p2 is not null").distinct().join(
        own.withColumnsRenamed({"acc_id": "prog", "dosage": "k", "phase": "kp"}), "prog"
    )
    for p, name in (("p1", "i"), ("p2", "j")):
        rows = rows.join(
            own.select(F.col("acc_id").alias(p), "marker", F.col("dosage").alias(name), F.col("phase").alias(f"{name}p")), [p, "marker"]
        )
    return rows


def triple_hypotheses(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """Per (prog, p1, p2, chrom), at markers known in all three, which of the progeny's chromosomes (a or b) comes from which parent.

    For parent 1 and 2: xa and xb (changes of the inherited parental chromosome if it is the parent of a, or of b), n_het (markers
    heterozygous in the
    parent), f02 (opposite homozygotes), fa and fb (heterozygous progeny whose a, or b, the homozygous parent can't have given) and n_hom.
    x_ab and
    f_ab are the sums with parent 1 for a and parent 2 for b, x_ba and f_ba those the other way; `ab` says that x_ab is smaller (else the
    other way
    is taken), min and max are the parents' changes in the way taken and in the other, and `agrees` says that the forbidden counts choose
    alike.
    Heterozygous progeny without a phase, and phaseless heterozygous parents, count in no change and no fa or fb."""
    rows = _known_triples(genotypes, triples)
    along = Window.partitionBy("prog", "p1", "p2", "chrom").orderBy("marker")
    counts = []
    for t, (g, ph) in enumerate((("i", "ip"), ("j", "jp")), 1):
        for c, plus in (("a", 1), ("b", -1)):
            side = F.expr(
                f"case when {g} = 1 and {ph} is not null then case when k = 0 then {ph} = -1 when k = 2 then {ph} = 1 when kp = "
                f"{plus} then {ph} = -1 when kp = {-plus} then {ph} = 1 end end"
            )
            rows = rows.withColumn(f"{c}{t}", side)
            rows = rows.withColumn(
                f"{c}{t}_before", F.last(f"{c}{t}", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
            )
            counts.append(tally(F.col(f"{c}{t}") != F.col(f"{c}{t}_before")).alias(f"x{c}{t}"))
            # plus: a has the reference allele, b the other one
            counts.append(tally(f"k = 1 and (({g} = 0 and kp = {-plus}) or ({g} = 2 and kp = {plus}))").alias(f"f{c}{t}"))
        counts += [
            tally(f"{g} = 1").alias(f"n_het{t}"), tally(f"abs({g} - k) = 2").alias(f"f02_{t}"), tally(f"{g} <> 1").alias(f"n_hom{t}")
        ]
    found = rows.groupBy("prog", "p1", "p2", "chrom").agg(*counts)
    for kind in "xf":
        found = found.withColumn(
            f"{kind}_ab", F.col(f"{kind}a1") + F.col(f"{kind}b2")
        ).withColumn(f"{kind}_ba", F.col(f"{kind}b1") + F.col(f"{kind}a2"))
    found = found.withColumn("ab", F.col("x_ab") < F.col("x_ba")).withColumn("agrees", F.col("ab") == (F.col("f_ab") < F.col("f_ba")))
    for t, (first, second) in ((1, "ab"), (2, "ba")):
        x, y = F.col(f"x{first}{t}"), F.col(f"x{second}{t}")
        found = found.withColumn(f"min{t}", F.when(F.col("ab"), x).otherwise(y)).withColumn(f"max{t}", F.when(F.col("ab"), y).otherwise(x))
    return found


def hypothesis_totals(by_chrom: DataFrame) -> DataFrame:
    """Per triple and parent, sums over chromosomes: the smaller and larger of xa and xb chosen for each parent alone, and those of
    the way taken for both."""
    made = []
    for t in (1, 2):
        made += [F.sum(F.least(f"xa{t}", f"xb{t}")).alias(f"alone_min{t}"), F.sum(F.greatest(f"xa{t}", f"xb{t}")).alias(f"alone_max{t}")]
        made += [F.sum(f"n_het{t}").alias(f"n_het{t}"), F.sum(f"min{t}").alias(f"min{t}"), F.sum(f"max{t}").alias(f"max{t}")]
    return by_chrom.groupBy("prog", "p1", "p2").agg(*made)


def phase_correction(genotypes: DataFrame, triples: DataFrame) -> DataFrame:
    """Per (prog, p1, p2, chrom) where the progeny's phase is best flipped.

    At phased heterozygous progeny whose parents allow that by its phase only (n markers), a parent is forbidden for a chromosome whose
    allele it doesn't
    have; ab counts that with parent 1 for a and parent 2 for b, ba the other way, and misfits is the smaller of the two. A switch after
    the first markers
    changes from one way to the other: ab_ba and ba_ab are the least counts with one, misfits_left the smaller of those. switch_from is
    the marker
    halfway between the switch's neighbours, from where phases are flipped (null: nowhere); of two ways as good the later switch counts."""
    rows = _known_triples(genotypes, triples).filter("k = 1 and kp is not null and not (i = j)")
    wrong = lambda g, allele: F.when(F.col(g) == 0, allele).when(F.col(g) == 2, 1 - allele).otherwise(0)
    a = F.when(F.col("kp") == -1, 1).otherwise(0)  # whether chromosome a has the alternative allele; b has the other one
    rows = rows.select(
        "prog", "p1", "p2", "chrom", "marker", (wrong("i", a) + wrong("j", 1 - a)).alias("ab"),
        (wrong("i", 1 - a) + wrong("j", a)).alias("ba")
    )
    part = Window.partitionBy("prog", "p1", "p2", "chrom")
    upto = part.orderBy("marker").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*", F.sum("ab").over(part).alias("all_ab"), F.sum("ba").over(part).alias("all_ba"), F.sum("ab").over(upto).alias("to_ab"),
        F.sum("ba").over(upto).alias("to_ba"), F.row_number().over(part.orderBy("marker")).alias("at"),
        F.lead("marker").over(part.orderBy("marker")).alias("next")
    )
    cut = lambda count, at, low, high: F.struct(count.alias("count"), at.alias("at"), low.alias("low"), high.alias("high"))
    forth, back = F.col("to_ab") + F.col("all_ba") - F.col("to_ba"), F.col("to_ba") + F.col("all_ab") - F.col("to_ab")
    each = rows.groupBy("prog", "p1", "p2", "chrom").agg(
        F.count("*").alias("n"), F.sum("ab").alias("ab"), F.sum("ba").alias("ba"), F.min("marker").alias("first"),
        F.min(cut(forth, F.col("at"), F.col("marker"), F.col("next"))).alias("forth"), F.min(cut(back, F.col("at"), F.col("marker"), F.col("next"))).alias("back"),
    )
    start = lambda total: cut(F.col(total), F.lit(0), F.lit(-1), F.col("first"))
    each = each.withColumn("forth", F.least("forth", start("ba"))).withColumn("back", F.least("back", start("ab")))
    one, two = F.col("forth.count"), F.col("back.count")
    taken = F.when(one < two, F.col("forth")).when(two < one, F.col("back")).when(
        F.col("forth.at") >= F.col("back.at"), F.col("forth")
    ).otherwise(F.col("back"))
    switch = F.when(taken["high"].isNotNull(), F.floor((taken["low"] + taken["high"]) / 2).cast("int"))
    return each.select(
        "prog", "p1", "p2", "chrom", "n", "ab", "ba", F.least("ab", "ba").alias("misfits"), one.alias("ab_ba"), two.alias("ba_ab"),
        F.least(one, two).alias("misfits_left"), switch.alias("switch_from")
    )


def flip_phases(genotypes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Genotypes with the phases of a progeny's chromosome flipped from its switch on; of several corrections of one chromosome the
    one with the least misfits left, then the first parents, counts."""
    best = corrections.groupBy(F.col("prog").alias("acc_id"), "chrom").agg(
        F.min(F.struct("misfits_left", "p1", "p2", "switch_from")).alias("b")
    ).select("acc_id", "chrom", F.col("b.switch_from").alias("__from")).filter("__from is not null")
    rows = genotypes.join(best, ["acc_id", "chrom"], "left")
    return rows.withColumn(
        "phase", F.when(F.col("marker") >= F.col("__from"), -F.col("phase")).otherwise(F.col("phase"))
    ).select(*genotypes.columns)
