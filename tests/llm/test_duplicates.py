"""Near copies and repeated passages against brute force, and their odd cases."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoquery.llm import jaccard_join as jj, substring_dedup as sd
from genoquery.llm.common import shingles, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r, n, size=2000):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], schema)


def corpus(seed, groups=12, alone=40):
    r = random.Random(seed)
    texts = [" ".join(words(r, r.randrange(1, 200))) for _ in range(alone)]
    for _ in range(groups):
        base = words(r, r.randrange(8, 300))
        for _ in range(r.randrange(2, 9)):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 20)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += texts[:5] + ["", "one", "one two", None, "  \n "]
    r.shuffle(texts)
    return list(enumerate(texts))


def brute(texts, similarity=0.8):
    sets = {i: set(shingles(word_hashes(t)).tolist()) for i, t in texts}
    links = {
        i: [
            j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity
        ] for i in sets
    }
    classes = {}
    for i in sorted(links):
        if i not in classes:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in classes:
                    classes[x] = i
                    stack += links[x]
    return {i: (classes[i], len(links[i])) for i in links}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links_match_brute_force(spark, seed):
    texts = corpus(seed)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.near_duplicates(frame(spark, texts)).collect()}
    assert found == brute(texts)


def test_many_near_copies_over_several_blocks(spark):
    r = random.Random(5)
    base = words(r, 150)
    texts = []
    for i in range(400):
        own = list(base)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(150)] = f"x{i}"
        texts.append((i, " ".join(own)))
    found = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jj.near_duplicates(frame(spark, texts)).collect()}
    wanted = brute(texts)
    assert sum(found[i] != wanted[i] for i in wanted) <= 4  # pairs at the very threshold may be missed by banding
    assert {i: c for i, (c, _) in found.items()} == {i: c for i, (c, _) in wanted.items()}


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.9995), (0.9, 0.99), (0.5, 0.95)):
        bands, rows = jj.choose_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= jj.MAX_HASHES
    with pytest.raises(ValueError):
        jj.choose_bands(0.01, 0.999)


@pytest.mark.parametrize("alone", [True, False])
def test_pairs_of_blocks_match_brute_force(alone):
    rng = np.random.default_rng(3)
    grams = [np.unique(rng.choice(60, rng.integers(1, 30)).astype(np.uint64)) for _ in range(40)]
    grams[20:] = [np.unique(np.append(g, np.uint64(99))) for g in grams[:20]]
    live = [rng.choice(6, 3, replace=False).tolist() for _ in grams]
    block = pd.DataFrame(
        {
            "side": 0 if alone else [0] * 20 + [1] * 20, "digest": [i.to_bytes(2, "big") for i in range(40)], "mult": 2, "live": live,
            "grams": [g.tobytes() for g in grams]
        }
    )
    found = {r.digest: (r.links, r.parent) for r in jj.verify(block, 0.6).itertuples()}
    links = {}
    for i in range(40):
        for j in range(40):
            if i != j and (alone or i // 20 != j // 20) and set(live[i]) & set(live[j]):
                a, b = set(grams[i].tolist()), set(grams[j].tolist())
                if len(a & b) >= 0.6 * len(a | b):
                    links.setdefault(i, []).append(j)
    assert {d: v[0] for d, v in found.items()} == {i.to_bytes(2, "big"): 2 * len(x) for i, x in links.items()} and len(links) > 10
    assert all(found[j.to_bytes(2, "big")][1] == found[i.to_bytes(2, "big")][1] for i, x in links.items() for j in x)


def test_the_same_links_in_larger_blocks(spark, monkeypatch):
    texts = corpus(9, groups=3, alone=5) + [(1000 + i, " ".join([f"t{k}" for k in range(60)] + [f"own{i}"])) for i in range(90)]
    monkeypatch.setattr(jj, "BLOCK_NODES", 4)
    few = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.near_duplicates(frame(spark, texts)).collect()}
    monkeypatch.setattr(jj, "FEW_PARTS", 2)
    monkeypatch.setattr(jj, "LARGE_NODES", 32)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.near_duplicates(frame(spark, texts)).collect()} == few == brute(texts)


def test_clashing_names_stay_as_they_are(spark):
    texts = [(i, f"{i // 2} " + " ".join(f"w{k}" for k in range(8)) if i < 4 else None) for i in range(6)]
    odd = spark.createDataFrame(
        [(i, t, "x", "y", i, None) for i, t in texts], "doc_id bigint, text string, __id string, text_key string, id bigint, gone string"
    )
    kept = jj.keep_one(odd)
    assert kept.columns == odd.columns and {tuple(r)[2:] for r in kept.collect()} == {("x", "y", i, None) for i in (0, 2, 4, 5)}


def test_keep_one(spark):
    text = " ".join(f"a{i}" for i in range(60))
    texts = [
        (5, text), (3, text), (9, text + " more"), (9, text + " more"), (4, None), (6, ""), (None, text),
        (7, "quite another text of seven words"), (7, "quite another text of seven words")
    ]
    kept = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"]) for r in jj.keep_one(frame(spark, texts)).collect())
    assert kept == [(-1, text), (3, text), (4, None), (6, ""), (7, "quite another text of seven words")]


def test_empty_table_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert jj.near_duplicates(empty).count() == 0 and jj.keep_one(empty).columns == empty.columns
    odd = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).withColumnsRenamed(
        {"lang": "id", "source": "digest", "n_chars": "class_id"}
    )
    assert {
        (r["doc_id"], r["class_id"]) for r in jj.near_duplicates(odd.select("doc_id", "text", "id", "digest")).collect()
    } == {(1, 1), (2, 1)}
    assert [r["doc_id"] for r in jj.keep_one(odd).collect()] == [1] and jj.keep_one(odd).columns == odd.columns


def test_a_very_long_text(spark):
    r = random.Random(8)
    long = words(r, 150_000, 10**6)
    texts = [(1, " ".join(long)), (2, " ".join(long[:-50])), (3, "w" * 300_000), (4, "w" * 300_000)]
    assert {x["doc_id"]: x["class_id"] for x in jj.near_duplicates(frame(spark, texts)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_words_beyond_the_power_table_differ():
    a = "x" * 5000 + "a" + "x" * 5000
    assert len({int(word_hashes(t)[0]) for t in (a, a[::-1] + "y", "x" * 10001, "x" * 4999 + "ax" + "x" * 5000)}) == 4


# ---- passages ---------------------------------------------------------------------------------------------------------------------

def covered(found, texts):
    marks = {i: np.zeros(len((t or "").split()), bool) for i, t in texts}
    for r in found:
        marks[r["doc_id"]][r["start_word"] : r["end_word"]] = True
    return marks


def exact(texts, n=50):
    """Words inside a run of n words that a text with a smaller id has."""
    seen, wanted = {}, {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        own = (t or "").lower().split()
        mark = np.zeros(len(own), bool)
        for a in range(len(own) - n + 1):
            key = tuple(own[a : a + n])
            if seen.setdefault(key, i) < i:
                mark[a : a + n] = True
        wanted[i] = mark
    return wanted


def test_planted_passages_are_found(spark):
    r = random.Random(3)
    passages = [words(r, n) for n in (51, 60, 90, 200, 400)]
    texts = []
    for i in range(80):
        own = words(r, r.randrange(20, 300))
        if i % 2 == 0:
            at = r.randrange(len(own))
            own[at:at] = passages[r.randrange(5)]
        texts.append((i, " ".join(own)))
    marks, wanted = covered(sd.repeated_passages(frame(spark, texts)).collect(), texts), exact(texts)
    for i, m in wanted.items():
        assert marks[i][m].all(), i
        assert marks[i].sum() <= m.sum() + 10, i  # little beyond, by chance
        assert m.any() or not marks[i].any(), i


def test_passages_of_lines_that_stand_alone_in_earlier_texts(spark):
    r = random.Random(12)
    texts, later = [], []
    for k in range(12):
        lines = [words(r, 49, 10**6) for _ in range(2)]
        texts += [(100 * k + i, " ".join([*words(r, 20, 10**6), *lines[i % 2], *words(r, 20, 10**6)])) for i in range(6)]
        later += [(5000 + 2 * k + i, " ".join([*words(r, 20, 10**6), *lines[0], *lines[1], *words(r, 20, 10**6)])) for i in range(2)]
    marks, wanted = covered(sd.repeated_passages(frame(spark, texts + later)).collect(), texts + later), exact(texts + later)
    for i, m in wanted.items():
        assert marks[i][m].all(), i
        assert m.any() or not marks[i].any(), i
    assert sum(m.any() for m in wanted.values()) == 12


def test_near_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(4)
    base = words(r, 120)
    near = list(base)
    for k in (30, 90):
        near[k] = "changed"
    texts = [
        (1, " ".join([*words(r, 40), *base, *words(r, 40)])), (2, " ".join([*words(r, 70), *near, *words(r, 10)])),
        (3, " ".join(words(r, 300)))
    ]
    found = sd.repeated_passages(frame(spark, texts)).collect()
    assert {x["doc_id"] for x in found} == {2}
    assert covered(found, texts)[2][70:190].mean() > 0.95 and all(x["similarity"] >= 0.8 for x in found)


def hidden(r, k, line):
    """A common line in an early text, and two texts with a passage of 52 words around it that differ in one word."""
    own = words(r, 52 - line, 10**6)
    shared = words(r, line, 10**6)
    passage = [*own[::2], *shared, *own[1::2]]
    other = list(passage)
    other[r.randrange(6, 46)] = "changed"
    around = lambda x: " ".join([*words(r, 30, 10**6), *x, *words(r, 30, 10**6)])
    return [(10 * k, around(shared)), (10 * k + 1, around(passage)), (10 * k + 2, around(other))]


def test_near_passages_around_a_line_of_an_earlier_text(spark):
    r = random.Random(15)
    texts = [x for k in range(60) for x in hidden(r, k, (40, 44)[k % 2])]
    found = sd.repeated_passages(frame(spark, texts)).collect()
    assert len({x["doc_id"] for x in found if x["doc_id"] - x["source_id"] == 1}) >= 59
    assert {x["doc_id"] % 10 for x in found} == {2}


def test_near_passages_around_a_common_line_are_removed(spark):
    r = random.Random(16)
    texts = [x for k in range(30) for x in hidden(r, k, 44)]
    kept = {x["doc_id"]: len(x["text"].split()) for x in sd.remove_repeats(frame(spark, texts)).collect()}
    assert sum(kept[10 * k + 2] <= 64 for k in range(30)) >= 29 and all(kept[10 * k + 1] == 112 for k in range(30))


def test_common_lines_after_repetition_make_no_pairs(spark, monkeypatch):
    r = random.Random(17)
    line, compared, counts = words(r, 13, 10**6), sd._compared, []

    def counted(base, met, *rest):
        counts.append(met.filter("id <> centre").count())
        return compared(base, met, *rest)

    monkeypatch.setattr(sd, "_compared", counted)
    odd = lambda i: [f"w{i}"] * 60 if i % 2 else words(r, 30, 10**6) * 3
    found = sd.repeated_passages(frame(spark, [(i, " ".join([*odd(i), *line])) for i in range(60)])).collect()
    assert not found and sum(counts) <= 120


@pytest.mark.parametrize("seed", range(40))
def test_windows_by_what_they_lack_match_brute_force(seed):
    r = np.random.default_rng(seed)
    width, kinds = int(r.integers(3, 9)), int(r.integers(2, 60))
    n, alike = int(r.integers(width + 3, 60)), width - int(r.integers(1, width))
    grams, shared = r.integers(1, kinds + 1, n).astype(np.uint64), set(r.permutation(kinds)[: kinds // 2 + 1].tolist())
    before = sd._before(grams, width)
    again, spare = np.arange(n) - before < width, sd.spared(before, width, alike, 0.8)
    at = np.array([a for a in range(n) if again[a] or int(grams[a]) in shared])
    may = np.where(at <= n - width, spare[at], -1)
    if not len(at) or may.max() < 0:
        return
    starts = sd.rare_grams(at, grams[at].view(np.int64), np.where(again[at], 0, 5), may, sd._roots(again, before)[at], width)[0]
    wanted = []
    for p in (p for p in at.tolist() if p + width - 1 <= at[-1]):
        own = set(grams[p : p + width].tolist())
        assert spare[p] == min(width - alike, len(own) // 5 + 1)
        if len(own - shared) <= spare[p]:
            wanted.append(p)
    assert [p for p in starts.tolist() if p + width - 1 <= at[-1]] == wanted


def test_a_passage_whose_counterpart_repeats_itself_less_often():
    mine = np.array([1] * 70 + [2] * 50, np.uint32)
    theirs = np.array([*range(10, 40), *[1] * 43, *[2] * 50], np.uint32)
    assert [x[:4] for x in sd.passages(mine, theirs, 5, 50, 0.8)] == [(0, 120, 30, 123)]


def test_passages_that_add_no_word_are_left_out():
    rows = [(1, 0, 50), (1, 10, 50), (1, 40, 100), (1, 120, 180), (1, 0, 180), (1, 99, 130), (2, 0, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["id", "start_word", "end_word"])
    kept = [tuple(r.values()) for b in sd._adding(iter([batch])) for r in b.to_pylist()]
    assert kept == [rows[0], rows[2], rows[3], rows[4], rows[6]]


def test_one_passage_in_many_texts(spark):
    r = random.Random(6)
    passage = words(r, 70)
    texts = [(i, " ".join([*words(r, 30), *passage, *words(r, 30)])) for i in range(300)]
    found = sd.repeated_passages(frame(spark, texts)).collect()
    assert {x["doc_id"] for x in found if x["source_id"] == 0} == set(range(1, 300)) == {x["doc_id"] for x in found}


def test_removal(spark):
    r = random.Random(7)
    p, q = words(r, 60), words(r, 25)
    texts = [
        (1, " ".join(p)), (2, "Start here.\n" + " ".join(p) + "\nand  end"), (3, " ".join(p)), (4, " ".join(q)), (5, None), (6, ""),
        (None, " ".join(p)), (8, " ".join(p[:40]))
    ]
    kept = {x["doc_id"]: (x["text"], x["n_chars"]) for x in sd.remove_repeats(frame(spark, texts)).collect()}
    assert kept[1][0] == " ".join(p) and kept[2] == ("Start here.\nand  end", 20) and 3 not in kept
    assert kept[4][0] == " ".join(q) and kept[5] == (None, None) and kept[6][0] == "" and kept[None][0] == " ".join(p) and kept[8][0] == " ".join(p[:40])
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_compact_windows_are_all_windows_with_that_minimum():
    rng = np.random.default_rng(2)
    for length in (5, 30, 80):
        grams = rng.integers(0, 2**63, length).astype(np.uint64)
        grams[length // 3] = grams[length // 4]
        width = 7
        xors, odds = sd._functions(2)
        for f, cs, ls, rs in sd.compact_windows(grams, width, 2):
            values = ((grams >> np.uint64(32)).astype(np.uint32) ^ xors[f]) * odds[f]
            wanted = {}
            for i in range(length):
                for j in range(i + width - 1, length):
                    c = i + int(values[i : j + 1].argmin())
                    lo, hi = wanted.get(c, (i, j))
                    wanted[c] = (min(lo, i), max(hi, j))
            assert {int(c): (int(a), int(b)) for c, a, b in zip(cs, ls, rs, strict=True)} == wanted
        if length < width:
            assert not list(sd.compact_windows(grams, width, 2))


def test_enough_functions_for_the_recall():
    assert sd.hash_count(0.8, 0.998, 1) == 4 and sd.hash_count(0.8, 0.998, 2) == 6
    with pytest.raises(ValueError):
        sd.hash_count(0.1, 0.9999, 30)


@pytest.mark.parametrize("seed", range(4))
def test_laid_over_ranges_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    f, lo = rng.integers(0, 3, 30), rng.integers(0, 600, 30)
    hi = lo + rng.integers(8, 30, 30)
    joined = np.zeros(700, bool)
    for a, b in zip(lo, hi, strict=True):
        joined[a : b + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0])))).reshape(-1, 2)
    wanted = []
    for a, b in edges.tolist():  # neighbours that touch but don't overlap are apart
        inside = [(x, y, z) for x, y, z in zip(f.tolist(), lo.tolist(), hi.tolist(), strict=True) if a <= y < b]
        cuts = [a, *sorted({c for c in range(a + 1, b) if not any(y < c <= z for _, y, z in inside)}), b]
        for c, d in zip(cuts, cuts[1:], strict=False):
            own = [x for x in inside if c <= x[1] < d]
            if any(len({x for x, y, z in own if y <= p and z >= p + 9}) >= 2 for p in range(c, d)):
                wanted.append((c, d - 1))
    groups = np.repeat([4, 1], 30)
    got = sd.overlaid(groups, *(np.concatenate((x, x)) for x in (f, lo, hi)), 10, 2)
    assert [(g, a, b) for g, a, b in zip(*(x.tolist() for x in got), strict=True)] == [(g, a, b) for g in (1, 4) for a, b in wanted]
    for agree in (1, 2, 3):
        places = {
            p for p in range(700) if len(
                {x for x, y, z in zip(f.tolist(), lo.tolist(), hi.tolist(), strict=True) if y <= p and z >= p + 9}
            ) >= agree
        }
        _, first, last = sd.agreed(np.zeros(30, np.int64), f, lo, hi, 10, agree)
        assert {p for a, b in zip(first.tolist(), last.tolist(), strict=True) for p in range(a, b + 1)} == places


def test_rows_of_one_id_are_told_apart(spark):
    r = random.Random(21)
    p, own = words(r, 80), words(r, 300)
    texts = [
        (1, " ".join(p)), (2, " ".join([*p, *words(r, 30)])), (2, " ".join(own)), (2, " ".join(own)), (3, " ".join([*words(r, 20), *own]))
    ]
    kept = [(x["doc_id"], x["text"]) for x in sd.remove_repeats(frame(spark, texts)).collect()]
    assert sorted(i for i, _ in kept) == [1, 2, 2, 2, 3] and kept.count((2, " ".join(own))) == 2
    assert [
        t for i, t in kept if i == 2 and t != " ".join(own)
    ] == [" ".join(texts[1][1].split()[80:])] and dict(kept)[3] == " ".join(texts[4][1].split()[:20])
    found = sd.repeated_passages(frame(spark, texts)).collect()
    assert {(x["doc_id"], x["source_id"]) for x in found} == {(2, 1), (3, 2)} and dict(frame(spark, texts).dtypes)["doc_id"] == "bigint"


def test_repeats_with_clashing_names_and_null_columns(spark):
    r = random.Random(22)
    p = " ".join(words(r, 70))
    df = spark.createDataFrame(
        [(i, p if i else None, None, None, 0, "s") for i in range(4)],
        "doc_id bigint, text string, key string, spans array<int>, n_chars int, __text string"
    ).withColumn("ID", F.lit(1))
    kept = sd.remove_repeats(df)
    assert kept.columns == df.columns and [x["doc_id"] for x in kept.orderBy("doc_id").collect()] == [0, 1]


def test_passages_with_a_wide_gap(spark):
    r = random.Random(23)
    one, two = words(r, 49, 10**6), words(r, 75, 10**6)
    texts = [(1, " ".join([*one, *words(r, 10, 10**6), *two])), (2, " ".join([*one, *words(r, 10, 10**6), *two]))]
    a, b = (word_hashes(t) >> np.uint64(32) for _, t in texts)
    assert sd.passages(b.astype(np.uint32), a.astype(np.uint32), 5, 50, 0.7)[0][:2] == (0, 134)
    long = [words(r, 300, 10**6) for _ in range(2)]
    t = [" ".join([*long[0], *words(r, 30, 10**6), *long[1]]) for _ in range(2)]
    c, d = ((word_hashes(x) >> np.uint64(32)).astype(np.uint32) for x in t)
    assert sorted(x[:2] for x in sd.passages(d, c, 5, 50, 0.8)) == [(0, 300), (330, 630)]


@pytest.mark.parametrize("step", [30, 33, 40])
def test_passages_with_changes_at_even_distances_are_whole(step):
    r = random.Random(step)
    text = words(r, 700, 10**6)
    other = ["changed" if i % step == step // 2 else x for i, x in enumerate(text)]
    hashed = [(word_hashes(" ".join(x)) >> np.uint64(32)).astype(np.uint32) for x in (other, text)]
    held = np.zeros(len(text), bool)
    for a, b, *_ in sd.passages(*hashed, 5, 50, 0.8):
        held[a:b] = True
    assert held.sum() >= 650


def test_a_very_long_and_a_repetitive_text_have_their_passages(spark):
    r = random.Random(24)
    long, p = words(r, 120_000, 10**6), words(r, 60, 10**6)
    texts = [(1, " ".join([*long[:60_000], *p, *long[60_000:]])), (2, " ".join(p)), (3, "w " * 100_000), (4, "w " * 60)]
    marks = covered(sd.repeated_passages(frame(spark, texts)).collect(), texts)
    assert marks[2].all() and marks[4].all() and not marks[1].any() and not marks[3].any()


def test_windows_are_deleted_after_use(spark):
    from pathlib import Path

    from genoquery.checkpoints import checkpoint_dir

    sd.repeated_passages(frame(spark, [(1, "a b"), (2, "a b"), (2, "a c")])).collect()
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    assert folder.is_dir() and not list(folder.rglob("windows-*")) and not list(folder.rglob("documents-*"))
