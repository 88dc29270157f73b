"""Hand-written cases for the rules of each operator."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoquery.functions.masks import pack
from genoquery.operators.prefix import running
from genoquery.operators import candidates, clusters, cluster1d, counts, dedup, filters, histogram, pairs, parents, pedigree_graph, phasing, triples
from genoquery.operators.components import connected_components
from genoquery.plans import pipeline
from genoquery.sources import matrix, tables, vcf

GENO = "acc_id string, marker int, marker_id string, chrom int, dosage int, phase int"


def geno(spark, rows, chrom=None, phase=None):
    """rows: id -> string of 0, 1, 2, X; phase: id -> string of +, - and spaces; chrom: string of digits."""
    made = []
    for a, text in rows.items():
        for m, c in enumerate(text):
            p = (phase or {}).get(a, "")
            made.append(
                (a, m, f"m{m:03d}", int(chrom[m]) if chrom else 1, None if c == "X" else int(c), {"+": 1, "-": -1}.get(p[m : m + 1]))
            )
    return spark.createDataFrame(made, GENO)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("size", [63, 64, 65, 128])
def test_masks_and_counts_agree_with_naive_counts(spark, size):
    import random

    r = random.Random(size)
    data = {f"a{i}": "".join(r.choice("012X") for _ in range(size)) for i in range(5)}
    found = {
        (x["q_id"], x["m_id"]): (
            x["n02"], x["n00_22"], x["n01_12"], x["n11"]
        ) for x in pairs.similar_pairs(geno(spark, data), 1.0).collect()
    }
    for a, b in itertools.combinations(sorted(data), 2):
        both = [(int(x), int(y)) for x, y in zip(data[a], data[b], strict=True) if "X" not in (x, y)]
        wanted = (
            sum(abs(x - y) == 2 for x, y in both), sum(x == y != 1 for x, y in both), sum(abs(x - y) == 1 for x, y in both),
            sum(x == y == 1 for x, y in both)
        )
        assert found[b, a] == wanted


def test_masks_with_gaps_between_markers(spark):
    g = geno(spark, {"a": "012" * 50, "b": "210" * 50}).filter("marker < 10 or marker >= 130")
    wide = {r["acc_id"]: r for r in pack(g).collect()}
    assert [len(wide[i]["m0"]) for i in "ab"] == [3, 3] and wide["a"]["m1"][1] == 0


def test_missing_markers_and_accessions(spark):
    g = geno(spark, {"a": "0X12", "b": "0X21", "c": "XXXX", "d": "0X22"})
    assert {r["acc_id"] for r in filters.accession_filter(g, 0.25).select("acc_id").distinct().collect()} == {"a", "b", "d"}  # at the bound is good
    kept = filters.marker_filter(g, 0.25, 0.0)
    assert rows(kept.select("marker", "marker_id").distinct(), "marker", "marker_id") == [(0, "m000"), (1, "m002"), (2, "m003")]
    assert rows(pairs.similar_pairs(g, 1.0), "q_id", "m_id") == [("b", "a"), ("d", "a"), ("d", "b")]  # c has no agmr
    assert rows(counts.accession_counts(g).filter("acc_id = 'c'"), "heterozygosity") == [(None,)]


def test_maf_bounds_are_inclusive(spark):
    g = geno(spark, {"a": "001", "b": "021", "c": "021", "d": "022"})  # frequencies 0, 0.75, 0.625
    assert rows(filters.marker_filter(g, 1.0, 0.25).select("marker_id").distinct(), "marker_id") == [("m001",), ("m002",)]


def test_ftr_weights_of_all_27_states(spark):
    states = list(itertools.product("012", repeat=3))
    g = geno(spark, {f"{p}{n:02d}": s[q] for n, s in enumerate(states) for q, p in enumerate("ijk")})
    t = spark.createDataFrame([(f"k{n:02d}", f"i{n:02d}", f"j{n:02d}") for n in range(27)], "prog string, p1 string, p2 string")
    found = {int(r["prog"][1:]): r["ftr_n"] for r in triples.statistics(triples.with_masks(t, pack(g))).collect()}
    inherits = {"0": {0}, "1": {0, 1}, "2": {1}}
    for n, (i, j, k) in enumerate(states):
        possible = {x + y for x in inherits[i] for y in inherits[j]}
        wanted = 0 if int(k) in possible else 2 if (i, j, k) in (("0", "0", "2"), ("2", "2", "0")) else 1
        assert found[n] == wanted, (i, j, k)
    assert sum(v > 0 for v in found.values()) == 12


def test_two_definitions_of_r(spark):
    g = geno(spark, {"p": "0022", "q": "0000", "k": "0112"})
    t = spark.createDataFrame([("k", "p", "q"), ("k", "p", None)], "prog string, p1 string, p2 string")
    found = {r["p2"]: r for r in triples.statistics(triples.with_masks(t, pack(g))).collect()}
    assert found["q"]["r1"] == 0.5 and found[None]["r1"] == 0.5 and found[None]["ftr"] is None
    g = geno(spark, {"p": "0022", "q": "0000", "k": "0210"})
    found = {r["p2"]: r for r in triples.statistics(triples.with_masks(t, pack(g))).collect()}
    assert found["q"]["r1"] == 0.5 and found[None]["r1"] == 0.75


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame([*chain, *star, (3, 2), (200, 200), (None, 5)], "src int, dst int")
    found = dict(rows(connected_components(df), "node", "component"))
    assert {found[i] for i in range(61)} == {0} and {
        found[i] for i in range(100, 160)
    } == {100} and found[200] == 200 and len(found) == 61 + 60 + 1
    assert dict(
        rows(connected_components(df, small=10**6), "node", "component")
    ) == found and connected_components(df.limit(0), small=5).count() == 0
    assert connected_components(df.limit(0)).count() == 0


def distances(spark, data):
    return spark.createDataFrame([(a, 0, b, 0, float(d)) for a, b, d in data], "id1 string, md1 bigint, id2 string, md2 bigint, d double")


def test_cluster_rules(spark):
    data = [("a", "b", 0.035), ("b", "c", 0.02), ("b", "a", 0.5), ("x", "y", 0.0), ("a", "z", 0.042), ("c", "z", 0.0419)]
    loaded = clusters.load_pairs(distances(spark, data))
    md = spark.createDataFrame([(i, k) for k, i in enumerate("abcxyz")], "id string, md bigint")
    found = clusters.members(loaded, md)
    assert rows(found, "cluster", "id") == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")]
    table = {r["cluster"]: r for r in clusters.cluster_table(loaded, found).collect()}
    a = table["a"]
    # a-c has no distance; z is near c (0.0419 < 1.2 * 0.035) but not near a (0.042 is not below it)
    assert (
        a["size"], a["n_unknown"], a["n_near"], a["n_pts_near"], a["gap"], a["min_degree"], a["ids"]
    ) == (3, 1, 1, 1, 0.0419, 1, "a,b,c")
    assert table["x"]["gap"] == 100 and table["x"]["max_d"] == 0


def test_weak_vertices_are_pruned(spark):
    core = [(a, b, 0.01) for a, b in itertools.combinations("abcdef", 2)]
    loaded = clusters.load_pairs(distances(spark, [*core, ("f", "g", 0.01)]))
    md = spark.createDataFrame([(i, 0) for i in "abcdefg"], "id string, md bigint")
    assert "g" in {r["id"] for r in clusters.members(loaded, md, factor=0.1).collect()}
    assert "g" not in {r["id"] for r in clusters.members(loaded, md, factor=0.2).collect()}


def members(spark, groups):
    return spark.createDataFrame([(g[0], i, k + 1) for g in groups for k, i in enumerate(g)], "cluster string, id string, rank int")


def test_votes(spark):
    g = geno(spark, {"a": "01X2", "b": "0X22", "c": "0012", "d": "0102", "e": "2XX1", "z": "1111"})
    two = rows(dedup.vote(g, members(spark, [["a", "b"]])), "acc_id", "marker", "dosage")
    assert [d for _, _, d in two] == [0, 1, 2, 2]
    four = rows(dedup.vote(g, members(spark, [["c", "d", "a", "e"]])), "acc_id", "marker", "dosage")
    assert [d for _, _, d in four] == [0, None, None, 2]  # 1 at marker 1 has two of four, which is not over a half
    assert {r["acc_id"] for r in dedup.unique_genotypes(g, members(spark, [["a", "b"]])).collect()} == {"a", "c", "d", "e", "z"}


def test_unique_pedigrees(spark):
    p = spark.createDataFrame(
        [(1, "k", "f", None), (2, "l", "f", "m"), (3, "k", "x", "y"), (4, None, "a", "b"), (5, "n", None, None), (6, "o", "k", "l")],
        "line int, prog string, fpar string, mpar string"
    )
    found = rows(dedup.unique_pedigrees(p, members(spark, [["l", "k"]])), "prog", "fpar", "mpar")
    assert found == [("l", "f", "m"), ("o", "l", "l")]


def test_roles(spark):
    g = geno(spark, {"p": "0202", "b": "0202", "o": "0202", "n": "0202", "c": "0202"})
    roles = spark.createDataFrame([(i, i if i != "c" else "b") for i in "pbonc"], "acc_id string, role string")
    found = set(rows(candidates.candidates(g, roles), "prog", "par"))
    assert found == {("b", "p"), ("c", "p"), ("o", "p"), ("b", "c"), ("c", "b"), ("o", "b"), ("o", "c")}


def test_best_pairs_with_ties_and_selfing(spark):
    t = spark.createDataFrame(
        [("k", "a", "a", 0.1), ("k", "a", "b", 0.1), ("k", "b", "b", None), ("k", "c", "c", 0.6)],
        "prog string, p1 string, p2 string, ftr double"
    )
    assert rows(parents.rank_pairs(t, most=3), "p1", "p2", "rank") == [("a", "a", 1), ("a", "b", 2)]
    c = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "prog string, par string, rank int")
    assert rows(parents.candidate_pairs(c), "p1", "p2") == [("a", "a"), ("a", "b"), ("b", "b")]


def test_levels(spark):
    g = geno(spark, {"p": "00112200", "q": "00002222", "k": "00011211", "u": "22110022"})
    ped = spark.createDataFrame([("k", "p", "zz")], "prog string, fpar string, mpar string")
    zero = parents.find_parents(g, ped, 0).collect()
    assert len(zero) == 1 and zero[0]["mpar"] is None and zero[0]["ftr"] is None and zero[0]["hgmr1"] == 0
    two = parents.find_parents(g, ped, 2, max_hgmr=0.4)
    assert {r["prog"] for r in two.collect()} == {"k"}  # an undefined ftr counts as bad
    one = parents.find_parents(g, ped, 1, max_hgmr=0.4)
    assert {r["prog"] for r in one.filter("kind = 'P' and fpar is null").collect()} == {"p", "q", "u"}


def test_crossovers(spark):
    g = geno(spark, {"p": "111111", "k": "022010"}, "112222", {"p": "++++- "})
    found = phasing.crossovers(g, spark.createDataFrame([("k", "p")], "prog string, par string")).first()
    # chromosome 1: sides 0, 1 (a change); chromosome 2: 1, 0 (a change); marker 4 is heterozygous in k, marker 5 unphased in p
    assert (found["x"], found["n_het"]) == (2, 4)
    t = spark.createDataFrame([("k", "p", None)], "prog string, p1 string, p2 string")
    r = phasing.parent_crossovers(g, t).first()
    assert (r["x_f"], r["x_m"], r["acc"]) == (2, None, 2)


def test_single_switches(spark):
    g = geno(spark, {"p": "11111", "k": "00200"}, "11111", {"p": "+++++"})
    ask = spark.createDataFrame([("k", "p")], "prog string, par string")
    assert phasing.chromosome_hypotheses(g, ask).first()["xa"] == 2
    assert phasing.chromosome_hypotheses(g, ask, True).first()["xa"] == 0


VCF = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta b\tc"]


def vcf_rows(spark, lines, **options):
    df = spark.createDataFrame([(x,) for x in [*VCF, *lines]], "value string")
    return {(r["acc_id"], r["marker_id"]): (r["dosage"], r["phase"]) for r in vcf.parse(df, None, vcf.Options(**options)).collect()}


def test_vcf_tokens(spark):
    body = lambda i, fmt, x, y: f"chr2\t{i}\t.\tA\tG\t.\t.\t.\t{fmt}\t{x}\t{y}"
    lines = [body(1, "GT", "0|1", "1|0"), body(2, "GT", "0/1", ".|."), body(3, "GT", "./.", "1|2"), body(4, "GT:DS:GP", "1|1:0:0.01,0.04,0.95", "1|1:0:0.4,0.3,0.3"), body(5, "GT:GP", "0|0:0.5,0.5", "0|0:x,y,z"),
             body(6, "DS:GP", "0.95:0,1,0", "1.4:0,1,0"), body(7, "DS", "3.0", ""), body(8, "DS", "1.95", "0")]
    found = vcf_rows(spark, lines)
    at = lambda i: (found["a b", f"chr2_{i}"], found["c", f"chr2_{i}"])
    none = (None, None)
    assert at(1) == ((1, 1), (1, -1)) and at(2) == ((1, None), none) and at(3) == (none, none)
    assert at(4) == ((2, None), none) and at(5) == (none, none) and at(6) == ((1, None), none) and at(7) == (none, none) and at(8) == ((2, None), (0, None))


def test_matrix_round_trip_and_errors(spark, tmp_path):
    g = geno(spark, {"b 1": "01X2", "a": "2110"}, "1122", {"b 1": " +  ", "a": " -+ "})
    matrix.write(g, str(tmp_path / "m"), "made by a test")
    back = matrix.read(spark, str(tmp_path / "m"))
    assert rows(back, *back.columns) == rows(g, *back.columns)
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    with pytest.raises(Exception, match="wrong number"):
        matrix.parse(lines("MARKER\ta\tb", "x\t0")).collect()
    with pytest.raises(Exception, match="not a dosage"):
        matrix.parse(lines("MARKER\ta", "x\tq")).collect()
    with pytest.raises(ValueError):
        matrix.sniff(lines("nothing"))
    assert rows(matrix.parse(lines("# c", "MARKER\ta\tb", "", "x\t3\t-1")), "dosage", "phase", "chrom") == [(1, -1, 0), (None, None, 0)]


def test_reference_set(spark):
    g = geno(spark, {"r1": "0102", "r2": "0102", "n1": "0102", "n2": "0102"})
    both = matrix.with_reference(g.filter("acc_id like 'r%'"), g.filter("acc_id like 'n%'"))
    assert rows(pairs.similar_pairs(both), "q_id", "m_id") == [("n1", "r1"), ("n1", "r2"), ("n2", "n1"), ("n2", "r1"), ("n2", "r2")]
    with pytest.raises(ValueError):
        matrix.with_reference(g.filter("marker < 2"), g)


def test_pedigree_file(spark):
    lines = spark.createDataFrame(
        [(1, "k\tf\tm"), (2, "k NA m"), (3, "NA f m"), (4, "x f m"), (5, "l NA NA"), (6, ""), (7, "# c"), (8, "m\tq\tf")],
        "line bigint, value string"
    )
    known = spark.createDataFrame([(i,) for i in "kflm"], "acc_id string")
    assert rows(
        tables.known_pedigrees(tables.pedigree_records(lines), known), "prog", "fpar", "mpar"
    ) == [("k", None, "m"), ("m", None, "f")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def patterned(spark):
    """Patterns of 90 accessions in 12 chunks, frequent and rare ones, some missing, some without a row; and their matches by plain loops."""
    rng = np.random.default_rng(3)
    kinds = np.array([2, 3, 40, 400] * 3)
    data = [(f"a{i:02}", c, int(v) if rng.random() > 0.1 else None) for i in range(90) for c, v in enumerate(rng.integers(0, kinds)) if rng.random() > 0.05]
    known = {i: {c: v for a, c, v in data if a == i and v is not None} for i in sorted({a for a, _, _ in data})}
    wanted = {(x, y): sum(known[x][c] == known[y].get(c) for c in known[x]) for x in known for y in known if x > y}
    return spark.createDataFrame(data, "acc_id string, chunk int, pattern bigint"), {k: v for k, v in wanted.items() if v}


def test_chunk_matches_in_blocks_equal_plain_loops(patterned, monkeypatch):
    monkeypatch.setattr(pairs, "MATCH_BLOCK", 32)
    monkeypatch.setattr(pairs, "STRIP", 10)
    patterns, wanted = patterned
    for sparse in (1, 8, 10**9):  # all by index, as it is, all compared
        monkeypatch.setattr(pairs, "SPARSE", sparse)
        found = pairs.chunk_matches(patterns)
        assert {(r["q_id"], r["m_id"]): r["matches"] for r in found.collect()} == wanted and found.count() == len(wanted)


def test_blocks_grow_so_that_what_is_sent_does_not_grow_with_the_square(spark, small, monkeypatch):
    from genoquery.plans.fixture import genotypes

    g = genotypes(spark, small)
    wanted = rows(pairs.distance_counts(g), "x", "n")
    monkeypatch.setattr(pairs, "BLOCKS", 3)
    monkeypatch.setattr(pairs, "PART", 7)
    wide = pairs._wide(g)
    n = wide.count()
    assert pairs.grid(wide, 8, grow=True).count() == 3 * n and pairs.grid(wide, 8).count() == -(-n // 8) * n
    monkeypatch.setattr(pairs, "BLOCK_ROWS", n // 5)
    assert 5 * n <= pairs.grid(wide, 8, grow=True).count() <= 6 * n
    monkeypatch.setattr(pairs, "BLOCK_ROWS", n)
    assert rows(pairs.distance_counts(g), "x", "n") == wanted


def test_matches_in_grown_blocks_equal_plain_loops(patterned, monkeypatch):
    patterns, wanted = patterned
    monkeypatch.setattr(pairs, "MATCH_BLOCK", 8)
    monkeypatch.setattr(pairs, "BLOCKS", 2)
    monkeypatch.setattr(pairs, "STRIP", 10)
    found = pairs.chunk_matches(patterns)
    assert {(r["q_id"], r["m_id"]): r["matches"] for r in found.collect()} == wanted and found.count() == len(wanted)


def test_all_estimates_are_no_rows_before_their_block_gives_them(spark, small):
    from genoquery.plans.fixture import genotypes

    assert "Join" not in plan_of(pairs.estimated_pairs(genotypes(spark, small), 1.0, 4, prefilter=False))


def test_only_pairs_with_enough_matches_become_rows(patterned):
    patterns, wanted = patterned
    found = pairs._matches(patterns, lambda n, q_ok, m_ok, chunks: n >= 0.3 * (q_ok * m_ok / chunks))
    ok, chunks = ({r["acc_id"]: r["n"] for r in patterns.groupBy("acc_id").agg(F.count(c).alias("n")).collect()} for c in ("pattern", "chunk"))
    assert {(r["q_id"], r["m_id"]) for r in found.collect()} == {(q, m) for (q, m), n in wanted.items() if n >= 0.3 * (ok[q] * ok[m] / chunks[q])}


def test_checkpoints_start_no_process_for_checksum_files(spark):
    from pathlib import Path

    from genoquery.checkpoints import checkpoint, checkpoint_dir

    files = lambda: set(Path(checkpoint_dir(spark).removeprefix("file:")).rglob("*part-*"))
    before = files()
    assert checkpoint(spark.range(1000, numPartitions=3)).count() == 1000
    assert len(files() - before) == 3 and spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") is None


def test_filtered_pairs_fetch_masks_for_the_wanted_pairs_only(spark, small):
    from genoquery.plans.fixture import genotypes

    plan = plan_of(pairs.filtered_pairs(genotypes(spark, small), 0.2, 4))
    assert plan.count("Join ") == 2


def test_filtered_pairs_are_not_dealt_anew_for_few_masks(spark, small, monkeypatch):
    from genoquery.plans.fixture import genotypes

    g = genotypes(spark, small)
    few = pairs.filtered_pairs(g, 0.2, 4)
    monkeypatch.setattr(pairs, "MASK_BYTES", 0)
    many = pairs.filtered_pairs(g, 0.2, 4)
    assert plan_of(few).count("BroadcastHashJoin ") == 2 and "BroadcastHashJoin " not in plan_of(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_phase_switches_of_similar_pairs_equal_those_of_listed_pairs(spark, small, monkeypatch):
    from genoquery.plans import queries

    monkeypatch.setattr(pairs, "BITS_AT_ONCE", 1000)
    rng = np.random.default_rng(4)
    data = []
    for i in range(25):
        for m in range(150):  # chromosomes take turns, and one marker has none
            d = int(rng.integers(0, 3)) if rng.random() > 0.1 else None
            data.append((f"a{i:02}", m, f"m{m}", None if m == 7 else m % 3, d, int(rng.choice([1, -1])) if d == 1 and rng.random() > 0.3 and i else None))
    g = spark.createDataFrame(data, "acc_id string, marker int, marker_id string, chrom int, dosage int, phase int")
    order = ["q_id", "m_id", "switches", "chances", "n_agree"]
    for distance in (0.6, 1.0):
        found = rows(pairs.similar_phase_switches(g, distance), *order)
        assert found == rows(pairs.phase_switches(g, pairs.similar_pairs(g, distance)), *order) and len(found) > 5
    assert "Join" not in plan_of(queries.queries()["p15_phase_switches"](spark, small))


def test_prefilter_recall(spark, small):
    from genoquery.plans.fixture import genotypes

    g = genotypes(spark, small)
    exact = set(rows(pairs.similar_pairs(g, 0.2), "q_id", "m_id"))
    for size in (3, 4, 7):
        found = set(rows(pairs.filtered_pairs(g, 0.2, size), "q_id", "m_id"))
        assert found <= exact and len(found) >= 0.9 * len(exact)


def test_vcf_subset(spark):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    fixed = "chr1\t5\tm\tA\tG\t.\tPASS\t.\tGT"
    keep = spark.createDataFrame([("c",), ("a",), ("c",), ("z",), (None,)], "acc_id string")
    lines = spark.createDataFrame([(v,) for v in ("##x\ty", f"{head}\ta\tb\tc\td", f"{fixed}\t0/0\t0/1\t1/1\t./.", f"{fixed}\t0/1\t\t0/0", "")], "value string")
    found = [r["value"] for r in vcf.subset(lines, keep).collect()]
    assert found == ["##x\ty", f"{head}\ta\tc", f"{fixed}\t0/0\t1/1", f"{fixed}\t0/1\t0/0", ""]
    assert [r["value"] for r in vcf.subset(lines, keep.filter("acc_id = 'z'")).collect()][1:3] == [head, fixed]
    short = lines.unionByName(spark.createDataFrame([(f"{fixed}\t0/1\t0/0",)], "value string"))
    with pytest.raises(Exception, match="last accession kept"):
        vcf.subset(short, keep).collect()


def test_vcf_subset_splits_a_line_once(spark):
    n = 30_000  # a split for each column kept takes minutes here
    names = spark.range(n).select(F.concat(F.lit("a"), F.col("id")).alias("acc_id"))
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"a{i}" for i in range(n))
    fixed = "chr1\t5\tm\tA\tG\t.\tPASS\t.\tGT"
    body = fixed + "".join(f"\t{i % 2}/1" for i in range(n))
    lines = spark.createDataFrame([(head,), (body,), (body,)], "value string")
    began = time.monotonic()
    assert [r["value"] for r in vcf.subset(lines, names.filter("acc_id <> 'a7'")).collect()][1:] == [fixed + "".join(f"\t{i % 2}/1" for i in range(n) if i != 7)] * 2
    assert time.monotonic() - began < 20


def test_histogram_bins(spark):
    x = spark.createDataFrame([(float(v),) for v in [-1, 0, 0.5, 1, 2, 2, 9]] + [(float("nan"),), (None,)], "x double")
    assert rows(
        histogram.histogram(x, histogram.Bins(0.0, 3.0, 1.0)), "bin", "n", "cumulative"
    ) == [(-1, 1, 1), (0, 2, 3), (1, 1, 4), (2, 2, 6), (3, 1, 7)]
    whole = histogram.auto_bins(spark.range(1000).select(F.col("id").cast("double").alias("x")))
    assert whole.lo == -0.5 and whole.width >= 1
    assert histogram.nice_width(0.0037) == pytest.approx(0.0025) and histogram.Bins(0, 10, 1.0).notched(1).width == pytest.approx(1.25)
    assert histogram.Bins(0.0, 10.0, 1.0).expanded(1.5).hi == 13 and histogram.Bins(0, 10, 1.0).limited(hi=5).count == 5


def test_linkage_tree(spark):
    merges = [("a", "b", 0.1), ("a", "c", 0.3)]
    assert clusters.newick(merges) == ["((a:0.05,b:0.05):0.1,c:0.15);"]
    rng = np.random.default_rng(3)
    edges = {
        (f"n{i:02}", f"n{j:02}"): float(round(rng.random(), 2)) for i, j in (sorted(rng.choice(40, 2, replace=False)) for _ in range(90))
    }
    root, wanted = {}, []
    for (a, b), d in sorted(edges.items(), key=lambda x: (x[1], x[0])):  # every step relabels all members
        x, y = sorted((root.get(a, a), root.get(b, b)))
        if x != y:
            wanted.append((x, y, d))
            root |= {k: x for k in [*(k for k, v in root.items() if v == y), y, x]}
    df = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a string, b string, d double")
    for most in (10, 1000):
        assert rows(clusters.linkage_tree(df, most), "height", "a", "b") == sorted((d, a, b) for a, b, d in wanted)
    assert clusters.linkage_tree(df.limit(0)).count() == 0


def test_splits_in_two(spark):
    x = spark.createDataFrame([(float(v),) for v in [1, 1.1, 1.2, 5, 5.1, 5.2, 5.3]], "x double")
    assert cluster1d.two_means(x).first()["n_left"] == 3 and cluster1d.jenks(x).first()["threshold"] == pytest.approx(3.1)
    y = spark.createDataFrame([(0.01 + 0.0001 * i,) for i in range(60)] + [(0.5 + 0.005 * i,) for i in range(60)], "x double")
    assert 40 <= cluster1d.left_boundary(y)["n_left"] <= 70 and cluster1d.left_boundary(x) is None and cluster1d.auto_threshold(x) is None
    assert cluster1d.inverse(4.0, 2) == 2
    same = spark.createDataFrame([(1.0,)] * 50, "x double")
    assert cluster1d.two_means(same).first()["n_left"] is None and cluster1d.density_split(same) is None and cluster1d.left_boundary(same)["quality"] == 0


def slow_boundary(x):
    """The boundary of the cluster at the left, size by size."""
    n, sizes, best, start, end = len(x), [], None, None, None
    middle = lambda k: (x[k - 1] + x[k]) / 2
    for i in range(8, n // 4):
        if 4 * i >= 0.85 * n:
            break
        ends = [middle(k * i // 2) if i % 2 == 0 else x[(k * i - 1) // 2] for k in (7, 9)]
        q = round(2 * (ends[1] - ends[0]) / max(middle(3 * i) - middle(i), cluster1d.TINY), 6)
        h = middle(4 * i)
        if best is None or q > best[0]:
            best = (q, 4 * i, h)
        if q >= 2:
            sizes.append((h, q))
            if start is None and q >= 3:
                start = i
        elif start is not None:
            if end is None:
                end = i
            elif i > 1.5 * end:
                break
    above = [h for h, q in sizes if q >= best[0] / 2]
    sums = [(round(sum(q for _, q in sizes[i : i + 33]), 6), -i) for i in range(1, len(sizes) - 32)]
    top = max(sums, default=None)
    return {
        "n_left": best[1], "threshold": best[2], "quality": best[0], "smooth": sizes[-top[1] + 16][0] if top else None, "smooth_quality": top[0] / 33 if top else None,
        "left_edge": min(above, default=None), "right_edge": max(above, default=None),
    }


def slow_separation(x, n_left, share=0.05):
    out = int(share * n_left)
    return 4 * share * (x[int(0.75 * n_left)] - x[int(0.25 * n_left)]) / max(x[n_left + out] - x[n_left - out], cluster1d.TINY)


def slow_density_split(x):
    """The lowest density around the two-means split, gap by gap."""
    n = len(x)
    within = lambda v: ((v - v.mean()) ** 2).sum()
    n_left = min(range(1, n), key=lambda k: (round(within(x[:k]) + within(x[k:]), 9), k) if x[k] > x[k - 1] else (math.inf, k))
    at = n_left - 1
    width = 0.7 * max(x[i + 15] - x[i] for i in range(int(0.7 * at), int(0.7 * at + 0.3 * (n - 1)) - 15))

    def density(v):
        z = np.abs(x - v)
        return ((1 / (1 + (math.pi * z / (2 * width)) ** 2) - 0.1) / 0.9)[z < width].sum()

    best = [density(x[at]), x[at], at]
    for js in (range(at, max(0, at - n_left // 4) - 1, -1), range(at + 1, min(at + (n - n_left) // 4, n - 2) + 1)):
        for j in js:
            done = False
            for e in (1 / 6, 0.5, 5 / 6):
                v = (1 - e) * x[j] + e * x[j + 1]
                d = density(v)
                if d < best[0] - 1e-12:
                    best = [d, v, j]
                elif d > 10 * best[0]:
                    done = True
            if done:
                break
    return {"n_left": best[2] + 1, "threshold": best[1], "density": best[0], "quality": slow_separation(x, best[2] + 1)}


@pytest.mark.parametrize("seed", [5, 6])
def test_densities_match_plain_loops(spark, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.sort(
        np.round(
            np.concatenate([rng.normal(0.02, 0.004, 340), rng.normal(0.4, 0.03, 2_500), rng.uniform(0, 0.4, 60)]), 4 if seed == 5 else 9
        )
    )
    values = spark.createDataFrame([(float(v),) for v in x], "x double")
    found = cluster1d.left_boundary(values)
    assert found == pytest.approx(slow_boundary(x)) and 200 <= found["n_left"] <= 400
    assert cluster1d.auto_threshold(values) == pytest.approx(found["smooth"])
    assert cluster1d.separation(values, 300) == pytest.approx(slow_separation(x, 300)) and cluster1d.separation(values, len(x)) is None
    assert cluster1d.density_split(values) == pytest.approx(slow_density_split(x))
    logs = cluster1d.left_boundary(values.filter("x > 0.002"), power="log")
    assert logs["threshold"] == pytest.approx(math.exp(slow_boundary(np.log(x[x > 0.002]))["threshold"]))


@pytest.mark.parametrize("seed", range(3))
def test_left_boundary_and_density_split_of_tied_values(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.sort(np.concatenate((rng.normal(0.01, 0.003, 700 + seed), rng.uniform(0.05, 1, 1300))).clip(0).round((3, 4, 2)[seed]))
    values = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert cluster1d.left_boundary(values) == pytest.approx(slow_boundary(x))
    rows = cluster1d.ranked(values)
    for at in (400, 700):
        first = int(0.7 * at)
        assert cluster1d.kernel_width(rows, len(x), at) == pytest.approx(0.7 * max(x[i + 15] - x[i] for i in range(first, int(0.7 * at + 0.3 * (len(x) - 1)) - 15)))


def test_left_boundary_and_kernel_width_of_billions_of_tied_values(spark):
    # 2.6 billion values, 60 of them different: work follows the different ones
    few = [(0.001 * k, 7 + k % 3) for k in range(20)] + [(0.5 + 0.01 * k, 9 - k % 4) for k in range(40)]
    many = spark.createDataFrame([(x, 6_000_000 * n) for x, n in few], "x double, n bigint")
    found = cluster1d.left_boundary(many)
    # the least size whose middle half is all 0.0 and whose valley ends at 0.001
    assert found["n_left"] == 4 * 9_333_334 and found["threshold"] == 0 and found["quality"] == pytest.approx(2 * 0.001 / 1e-9)
    rows = cluster1d.ranked(many)
    total = rows.agg(F.sum("n")).first()[0]
    assert total > 2_500_000_000 and cluster1d.kernel_width(rows, total, total // 3) == pytest.approx(0.7 * (0.5 - 0.019))


def test_best_pedigrees(spark):
    good, self_, bad, part = "0 00 00 00", "1 01 01 00", "1 11 00 11", "0 0x 00 00"
    data = [
        ("a", "P", "x", "y", good, 0.01), ("a", "A", "u", "v", self_, 0.02), ("a", "A", "u", "w", bad, 0.001),
        ("b", "P", "x", "y", bad, 0.4), ("b", "A", "u", "v", good, 0.03), ("b", "A", "s", "t", good, 0.02), ("b", "A", "q", "r", good, None),
        ("c", "P", "x", "y", bad, 0.4), ("c", "A", "u", "v", part, 0.01), ("c", "A", "u", "w", bad, 0.3), ("d", "P", "x", None, "x 00 xx xx", None),
    ]
    found = {
        r["prog"]: (r["n_good"], r["verdict"], r["first"] and r["first"]["p1"], r["second"] and r["second"]["p1"]) for r in cluster1d.best_pedigrees(
            spark.createDataFrame(data, "prog string, kind string, p1 string, p2 string, category string, ftr double")
        ).collect()
    }
    assert found == {"a": (2, "ped", "x", "u"), "b": (3, "alt", "s", "u"), "c": (0, "none", "u", "x"), "d": (0, "none", None, None)}


def test_best_pairs_of_many_candidates_match_the_ranking_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 60
    dosages = {f"c{i:03}": "".join(rng.choice(list("012X"), 70, p=[0.35, 0.3, 0.3, 0.05])) for i in range(n)}
    g = geno(spark, dosages)
    found = spark.createDataFrame(
        [(p, c, r + 1) for p in ("c000", "c001") for r, c in enumerate(sorted(dosages)[2:])], "prog string, par string, rank int"
    )
    wide = pack(g)
    every = parents.rank_pairs(triples.statistics(triples.with_masks(parents.candidate_pairs(found), wide)), max_ftr=0.9, most=5)
    for cells in (100, 1 << 18):
        monkeypatch.setattr(parents, "PAIR_CELLS", cells)
        assert rows(parents.best_pairs(found, wide, 0.9, 5), "prog", "p1", "p2") == rows(every, "prog", "p1", "p2")
    assert parents.best_pairs(found, wide, -1.0).count() == 0


def test_phases_are_flipped_from_the_switch_on(spark):
    # a progeny whose first chromosome is its first parent's up to marker 9, and its second parent's from marker 10 on
    data = [("p", m, "m", 1, 0, None) for m in range(20)] + [("q", m, "m", 1, 2, None) for m in range(20)] + [
        ("k", m, "m", 1, 1, 1 if m < 10 else -1) for m in range(20)
    ]
    g = spark.createDataFrame(data, GENO)
    family = spark.createDataFrame([("k", "p", "q")], "prog string, p1 string, p2 string")
    row = phasing.phase_correction(g, family).collect()[0].asDict()
    assert {c: row[c] for c in ("n", "ab", "ba", "misfits", "ab_ba", "ba_ab", "misfits_left", "switch_from")} == {
        "n": 20, "ab": 20, "ba": 20, "misfits": 20, "ab_ba": 0, "ba_ab": 20, "misfits_left": 0, "switch_from": 9
    }
    flipped = phasing.flip_phases(g, phasing.phase_correction(g, family)).filter("acc_id = 'k'")
    assert [r["phase"] for r in flipped.orderBy("marker").collect()] == [1] * 9 + [-1] + [1] * 10
    same = phasing.phase_correction(g.withColumn("phase", F.abs("phase")), family).collect()[0]
    assert same["misfits"] == 0 and same["switch_from"] is None


def test_running_sums(spark):
    data = [(i * 7 % 101, float(i)) for i in range(101)]
    df = spark.createDataFrame(data, "k int, v double")
    for down in (False, True):
        got = sorted(
            (r["k"], r["s"], r["m"], r["next"]) for r in running(
                df, "k", {"s": F.col("v")}, {"m": F.col("v")}, following="next", descending=down
            ).collect()
        )
        order = sorted(data, reverse=down)
        wanted = [
            (k, sum(v for _, v in order[: i + 1]), min(v for _, v in order[: i + 1]), order[i + 1][0] if i < 100 else None) for i,
            (k, _) in enumerate(order)
        ]
        assert got == sorted(wanted, key=lambda x: x[0])
    assert running(df.limit(0), "k", {"s": F.col("v")}).count() == 0


def test_ancestors_of_deep_pedigrees_and_long_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(260)], "parent bigint, child bigint")
    found = {(r["id"], r["ancestor"]): r["depth"] for r in pedigree_graph.ancestors(chain).collect()}
    assert found == {(i, j): i - j for i in range(261) for j in range(i)}
    assert {r["id"]: r["depth"] for r in pedigree_graph.ancestors(chain, 3).filter("ancestor = 0").collect()} == {1: 1, 2: 2, 3: 3}
    loop = chain.unionByName(spark.createDataFrame([(150, 0), (150, 300)], "parent bigint, child bigint"))
    assert rows(pedigree_graph.cycles(loop), "id") == [(i,) for i in range(151)]


def test_one_triple_of_each_accession_and_case(spark):
    links = spark.createDataFrame([("f", "a"), ("m", "a"), ("a", "x"), ("a", "y"), ("a", "z"), ("f", "s")], "parent string, child string")
    every = {tuple(r) for r in pedigree_graph.family_triples(links).collect()}
    drawn = [tuple(r) for r in pedigree_graph.random_triples(links).collect()]
    assert set(drawn) <= every and {r[:2] for r in drawn} == {r[:2] for r in every} and len(drawn) == len({r[:2] for r in drawn})


def test_graph(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("r", "a")], "parent string, child string")
    assert rows(pedigree_graph.cycles(loop), "id") == [("a",), ("b",), ("c",)]
    accs = spark.createDataFrame([(f"x{i}",) for i in range(20)], "acc_id string")
    for r in pedigree_graph.random_pedigrees(accs).collect():
        assert len({r["prog"], r["fpar"], r["mpar"]}) == 3


def test_pipeline_of_a_matrix(spark, small):
    from genoquery.plans.fixture import genotypes, pedigrees

    out = pipeline.vcf_to_parents(
        matrix.to_lines(genotypes(spark, small)).select("value"), pedigrees(spark, small), pipeline.Parameters(vote=True, level=2)
    )
    assert out["unique"].select("acc_id").distinct().count() < out["genotypes"].select("acc_id").distinct().count()
    assert out["parents"].filter("kind = 'P'").count() > 0


def test_stream_of_new_accessions(spark, tmp_path):
    from genoquery.streaming.incremental import find_duplicates

    g = geno(spark, {"r1": "0102", "n1": "0102", "n2": "2020"})
    g.filter("acc_id <> 'r1'").write.parquet(str(tmp_path / "in"))
    found = {}
    stream = spark.readStream.schema(GENO).parquet(str(tmp_path / "in"))
    run = find_duplicates(
        stream, g.filter("acc_id = 'r1'"), lambda df, n: found.update({n: rows(df, "q_id", "m_id")})
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert found == {0: [("n1", "r1")]}
