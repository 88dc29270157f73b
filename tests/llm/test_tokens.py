"""Packing, token counts and tiling against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genoquery.llm import decontaminate as dc, packing, token_counts as tc

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    "Hello world. This is it!", "", None, "x", "a\nb\n\nc\n", "Ünïcödé 漢字 🙂🙂 done.\nfin", "<|endoftext|> in a text <|endoftext|>", "tabs\t\tand   spaces  ", "no stop " * 900, "y" * 9000, "One. Two. " * 700, "\r\nA\r\nB", "\x00\x01 odd ﻿",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, start int, id string")


def ids_of(text):
    return HF.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library():
    encode, pieces = packing.encoder("byte_bpe_50k.tiktoken")
    for t in TEXTS:
        ids = encode(t or "")
        assert ids.tolist() == ids_of(t)
        assert b"".join(pieces[i] for i in ids) == (t or "").encode()


def test_ids_equal_on_a_table_and_on_every_kind_of_character():
    import pyarrow.parquet as pq

    encode, _ = packing.encoder("byte_bpe_50k.tiktoken")
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(points[a : a + 256]) for a in range(0, 0x30000, 256)]  # every character of the first three planes beside its neighbours
    texts += [f"a{c}b {c} {c}1{c}{c}" for c in points[:0x3000:7] + points[0xFB00:0x10000:11]]
    texts += [
        "e\u0301 \u0301\u0301 n\u0303o", "'s 'S 'Ll I'VE don't", "<|endoftext|><|endoftext|>x", "<|endoftext", "1234567 1,000.5",
        "\u200b \u2028\u2029\x85", "  \n \r\n\t x", "\ufeff\ufffe"
    ]
    for t, own in zip(texts, HF.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t).tolist() == own.ids, t[:40]


def check_pieces(rows, texts, ids_of_text, window=1024):
    """Every id in exactly one piece, sequences gapless and within the window; (ids wasted, ids)."""
    by_sequence, at = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        whole = ids_of_text[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] = r["start"] + r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(w) for i, w in ids_of_text.items()}
    sizes = []
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        sizes.append(end)
    assert max(sizes) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes), sum(sizes)


def test_a_line_longer_than_a_stretch(spark, monkeypatch):
    """A partition is packed stretch by stretch: all ids are there once, and padding stays small."""
    r = random.Random(3)
    texts = [" ".join(r.choice(("word", "stop.", "other", "x1")) for _ in range(r.randrange(1, 900))) for _ in range(900)]
    whole = {i: np.array([*ids_of(t), 0], "<u4") for i, t in enumerate(texts)}
    assert sum(map(len, whole.values())) > packing.STRETCH
    rows = packing.pack(frame(spark, texts).coalesce(1)).collect()
    wasted, ids = check_pieces(rows, texts, whole)
    assert wasted < 0.005 * ids + 1024 and max(r["start"] for r in rows) > 0


def test_packing_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame(
        [(None, "a b c."), (None, None), (3, "same"), (3, "same"), (3, "other text")], "doc_id bigint, text string"
    ).withColumn("sequence_id", F.lit("x"))
    rows = packing.pack(df.coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows if r["start"] == 0) == sorted(
        [
            (0, len(ids_of("a b c.")) + 1), (0, 1), (3, len(ids_of("same")) + 1), (3, len(ids_of("same")) + 1),
            (3, len(ids_of("other text")) + 1)
        ]
    )
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_packing_covers_every_id_once(spark):
    texts = TEXTS * 6
    rows = packing.pack(frame(spark, texts)).collect()
    whole = {i: np.array([*ids_of(t), 0], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(whole)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(whole[i])
            at += r["length"]
            assert zlib.crc32(whole[i][r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(whole[i])
    waste = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        waste += 0 if at & (at - 1) == 0 else 1024 - at
    parts = len({s >> 36 for s in by_sequence})
    assert waste <= 0.02 * sum(map(len, whole.values())) + 1024 * parts
    assert packing.pack(frame(spark, [])).count() == 0


def slow_cost(where, cost, window):
    best = {0: 0}
    for b, c in zip(where, cost, strict=True):
        best[b] = c + min(v + (0 if (b - a) & (b - a - 1) == 0 else window - (b - a)) for a, v in best.items() if 0 < b - a <= window)
    return best[where[-1]]


def test_cuts_are_the_cheapest():
    r = random.Random(1)
    for _ in range(40):
        window = 32
        where = [0]
        while len(where) < 30:
            where.append(where[-1] + r.randrange(1, 20))
        where = where[1:]
        cost = [r.randrange(0, 9) for _ in where]
        chosen = packing.cuts(where, cost, window)
        total, before = 0, 0
        for i in chosen:
            n = where[i] - before
            assert 0 < n <= window
            total += cost[i] + (0 if n & (n - 1) == 0 else window - n)
            before = where[i]
        assert before == where[-1] and total == slow_cost(where, cost, window)


def test_boundaries_are_dense_enough():
    ends = np.zeros(300, bool)
    ends[7] = True
    for ids in (np.zeros(1, int), np.full(5000, 3), np.array([7, 7, 1, 7, 0]), np.tile([1] * 50 + [7], 40)):
        where, cost = packing.boundaries(ids, ends)
        assert where[-1] == len(ids) and cost[-1] == 0 and (
            np.diff(np.concatenate(([0], where))) > 0
        ).all() and np.diff(np.concatenate(([0], where))).max() <= packing.STRIDE


# ---- token counts -----------------------------------------------------------------------------------------------------------------

def slow_counts(text, spans, rule):
    """From the library's own offsets of bytes, token by token."""
    encode, pieces = packing.encoder("byte_bpe_50k.tiktoken")
    at_byte = np.cumsum([0, *(len(c.encode()) for c in text)])
    sections = [(at_byte[a], at_byte[b]) for a, b in spans]
    out, rest, at = [0.0] * len(spans), 0.0, 0
    for i in encode(text):
        a, b = at, at + len(pieces[i])
        at = b
        share = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        if rule == "split":
            for k, s in enumerate(share):
                out[k] += s / (b - a)
            rest += 1 - sum(share) / (b - a)
            continue
        if rule == "most":
            k = max(range(len(share)), key=lambda k: (share[k], -k)) if any(share) else None
        else:
            spot = a if rule == "first" else b - 1
            k = next((k for k, (x, y) in enumerate(sections) if x <= spot < y), None)
        if k is None:
            rest += 1
        else:
            out[k] += 1
    return out, rest


@pytest.mark.parametrize("rule", tc.RULES)
def test_counts_match_brute_force(spark, rule):
    texts = [t for t in TEXTS if t]
    found = {}
    for r in tc.token_counts(frame(spark, texts), rule=rule).collect():
        found.setdefault(r["doc_id"], {})[r["section"]] = r["tokens"]
    for i, t in enumerate(texts):
        out, rest = slow_counts(t, tc.line_spans(t), rule)
        assert rest < 1e-9
        assert [found[i][k] for k in range(len(out))] == pytest.approx(out) and sum(out) == pytest.approx(len(ids_of(t)))


@pytest.mark.parametrize("rule", tc.RULES)
def test_given_sections_with_gaps(spark, rule):
    text, spans = "Prompt: tell me. Answer: nothing at all, 漢字!", [(0, 11), (11, 16), (24, 44)]
    df = spark.createDataFrame(
        [(1, text, [{"start": a, "end": b} for a, b in spans]), (2, text, None), (3, None, None)],
        "doc_id int, text string, s array<struct<start:int,end:int>>"
    )
    found = {(r["doc_id"], r["section"]): r["tokens"] for r in tc.token_counts(df, spans_col="s", rule=rule).collect()}
    out, rest = slow_counts(text, spans, rule)
    assert [found[1, k] for k in range(3)] == pytest.approx(out) and found[1, None] == pytest.approx(rest)
    assert found[2, None] == len(ids_of(text)) and found[3, 0] == 0


def test_empty_texts_have_a_row(spark):
    rows = tc.token_counts(frame(spark, [None, ""])).collect()
    assert [(r["section"], r["tokens"], r["doc_tokens"]) for r in rows] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        tc.attribute(np.array([1]), np.array([0]), np.array([1]), "other")


# ---- tiling -----------------------------------------------------------------------------------------------------------------------

def slow_tiles(a, b, least):
    """Greedy string tiling as first described, without hashes."""
    ma, mb, found = [False] * len(a), [False] * len(b), []
    while True:
        best, at = least - 1, None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if at is None:
            return found
        for k in range(best):
            ma[at[0] + k] = mb[at[1] + k] = True
        found.append((*at, best))


def test_tiles_match_brute_force():
    r = random.Random(2)
    for _ in range(30):
        a = np.array([r.randrange(6) for _ in range(r.randrange(1, 40))], np.uint64)
        b = np.array([r.randrange(6) for _ in range(r.randrange(1, 60))], np.uint64)
        if r.random() < 0.5 and len(a) > 8:
            b = np.concatenate((b, a[len(a) // 2 :], a[: len(a) // 2]))
        assert dc.tiles(a, b, 3) == slow_tiles(a.tolist(), b.tolist(), 3)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_leaks(spark):
    r = random.Random(9)
    word = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    item, other = word(40), word(30)
    noise = lambda: " ".join(word(80))
    texts = [
        noise() + " " + " ".join(item) + " " + noise(), f"{noise()} {' '.join(item).upper()}!! {noise()}", " ".join(item[20:]) + " " + noise() + " " + " ".join(item[:20]),  # whole, shouted, reordered
        noise() + " " + ", ".join(item), " ".join(item[:12]) + noise(), noise(), "", None, " ".join(other) + " " + " ".join(item),
    ]
    bench = benchmark(spark, [(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "too short"), (5, " ".join(other))])
    docs = frame(spark, texts)
    found = {(x["doc_id"], x["item_id"]): x for x in dc.leaks(docs, bench).collect()}
    assert set(found) == {(0, 1), (1, 1), (2, 1), (3, 1), (8, 1), (8, 2), (8, 5)}
    assert found[2, 1]["n_tiles"] == 2 and found[2, 1]["coverage"] == 1 and found[0, 1]["longest_tile"] == 40
    assert sorted(x["doc_id"] for x in dc.drop_leaks(docs, bench).collect()) == [4, 5, 6, 7]
    parts = {(x["doc_id"], x["item_id"]) for x in dc.leaks(docs, bench, part_words=60).collect()}
    assert parts == set(found)  # a benchmark in parts gives the same
    assert dc.leaks(frame(spark, []), bench).count() == 0 and dc.leaks(docs, benchmark(spark, [])).count() == 0
    assert dc.drop_leaks(docs, benchmark(spark, [])).count() == len(texts)


def test_repetitive_texts_take_bounded_memory(spark):
    """200 items of one repeated word, and a text of 8000 such words."""
    import tracemalloc

    items = dc.Items([(i, "word " * 8000) for i in range(200)], dc.MIN_TILE)
    text = dc.tokens("word " * 8000)
    tracemalloc.start()
    found = list(items.matched(text, dc.MIN_TILE, dc.COVERAGE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 200 and all(x[1:] == (1.0, 1, 8000) for x in found) and peak < 300e6


def test_seeded_words_match_brute_force(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(dc, "CHUNK", 7)
    rows = [(i, " ".join(f"w{r.randrange(8)}" for _ in range(r.randrange(0, 40)))) for i in range(30)]
    items, text = dc.Items(rows, 3), dc.tokens(" ".join(f"w{r.randrange(8)}" for _ in range(60)))
    grams = set(zip(text, text[1:], text[2:], strict=False))
    wanted = {}
    for i, words in enumerate(items.words):
        inside = {k + d for k in range(len(words) - 2) if tuple(words[k : k + 3]) in grams for d in range(3)}
        if inside:
            wanted[i] = len(inside)
    for chunk in (7, 1 << 18):
        monkeypatch.setattr(dc, "CHUNK", chunk)
        where, counts = items._seeded(np.unique([g for g in dc.shingles(text, 3) if g in items.seeds]), 3)
        assert dict(zip(where.tolist(), counts.tolist(), strict=True)) == wanted


def test_leaks_of_repeated_rows_and_clashing_names(spark):
    item = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item, 5), (1, item, 5), (None, item, 6), (2, None, 7)], "doc_id bigint, text string, item_id int")
    bench = benchmark(spark, [(9, item), (None, item), (9, item)]).withColumn("doc_id", F.lit(1))
    assert sorted(
        (str(x["doc_id"]), str(x["item_id"])) for x in dc.leaks(docs, bench).collect()
    ) == sorted([(d, i) for d in ("1", "1", "None") for i in ("9", "9", "None")])
    assert [tuple(x) for x in dc.drop_leaks(docs, bench).collect()] == [(2, None, 7)]


def test_token_counts_of_repeated_null_and_long_rows(spark):
    long = "word and more.\n" * 30_000
    df = spark.createDataFrame(
        [(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, long)], "doc_id bigint, text string"
    ).withColumn("section", F.lit("x"))
    rows = tc.token_counts(df).collect()
    for i, n, t in ((1, 2, "a\nb"), (None, 1, "a\nb"), (2, 1, long)):
        assert sum(r["tokens"] for r in rows if r["doc_id"] == i) == pytest.approx(n * len(ids_of(t)))
    assert tc.token_counts(df.limit(0)).count() == 0
