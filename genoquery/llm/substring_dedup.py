"""Substring dedup by compact windows.

The tokens are a text's word 5-grams by position. For a hash function, the windows of at least MIN_WORDS words that share one
minimum form a compact window (l, c, r): every sub-sequence that starts in [l, c], ends in [c, r] and is long enough has the
signature h(c). Its centres are the nodes of the Cartesian tree over the token hashes whose range is wide enough; as every
smaller neighbour of such a node is one too, the tree is built on the centres alone.

1. Each text gives (signature, id, range of words) for each hash function, written once. Signatures found in two documents or more are
   counted with partial sums; a group's first document (smallest id) stands for it, so links grow with the group's size, not its square.
2. Interval join: the windows that a document shares with a first document are laid over one another, by hash function. Where windows of
   at least AGREE functions have MIN_WORDS words in common, the ranges joined to that place by overlaps are a candidate.
3. The candidates' words are fetched and verified: a passage is reported if it has at least MIN_WORDS words and its set of
   5-grams has a Jaccard similarity of at least 0.8 with its counterpart's.
4. A group's first document may hold only a shorter common line. So where all functions' windows are shared, some by three documents
   or more, but no passage found so far covers them, the windows of MIN_WORDS words are linked once more by a hash of all their words:
   there the first document with the place still open has the whole window, and exact repeats are found whatever the lines they are made of.
5. Near passages that common lines hide in the same way: where windows of AGREE functions are shared, some by three documents or more, and
   the place is still open, documents are paired by rare 5-grams. Two windows that agree in ALIKE of their 5-grams share one of the rarest
   of each (as many as may differ, and one more), so windows with more 5-grams of their own drop out, and every pair left is verified.
   A later document's open windows count 5-grams that an earlier one has, an earlier one's those of such windows; of the passages found
   those with a word that none before them has are kept.

The number of hash functions follows from the target recall: a passage that agrees in a share s of its 5-grams shares the
signature of one function with probability s, and AGREE of k functions with that of the binomial distribution.

Defined results: null or empty texts and texts shorter than MIN_WORDS have no passages; a text of any length is read whole. Rows with a
null id are never compared and stay as they are. Rows that repeat an id and its text are one document; rows of one id with different
texts are documents of their own, in order of the texts' hashes, and neither is cut by the other's passages. Passages repeated only inside
one
document are left alone. Of documents that share a passage the one with the smallest id keeps it. An empty table gives no rows; other
columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from genoquery.checkpoints import PLAIN_FILES, checkpoint, checkpoint_dir, sweep
from genoquery.llm.common import SHINGLE, SIMILARITY, column, lean, mix, shingles, ship, table, unused, word_hashes

MIN_WORDS = 50
TARGET_RECALL = 0.99
AGREE = 2
REACH = 64
MAX_GAP = 12
MAX_FUNCTIONS = 64


def hash_count(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, agree: int = AGREE) -> int:
    """The least number of functions of which `agree` share a signature with probability `recall` at the similarity."""
    for k in range(agree, MAX_FUNCTIONS + 1):
        if 1 - sum(comb(k, i) * similarity**i * (1 - similarity) ** (k - i) for i in range(agree)) >= recall - 1e-12:
            return k
    raise ValueError(f"{MAX_FUNCTIONS} functions do not reach a recall of {recall} at a similarity of {similarity}")


@lru_cache(8)
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(4099))
    return rng.integers(1, 2**32, k, dtype=np.uint32), rng.integers(1, 2**32, k, dtype=np.uint32) | np.uint32(1)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` columns, by doubling."""
    low, step = keys, 1
    while 2 * step <= width:
        low = np.minimum(low[:, :-step], low[:, step:])
        step *= 2
    rest = width - step
    return np.minimum(low[:, : low.shape[1] - rest], low[:, rest:]) if rest else low


def _ranges(values: list[int], places: list[int], length: int) -> tuple[list[int], list[int]]:
    """Each node's range in the Cartesian tree (the leftmost of equal values is the smaller), from one pass with a stack."""
    left, right, stack = [0] * len(values), [length - 1] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else 0
        stack.append(i)
    return left, right


def compact_windows(grams: np.ndarray, width: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(function, centres, l, r) for each of k hash functions: the compact windows at least `width` tokens wide."""
    if len(grams) < width:
        return
    xors, odds = _functions(k)
    hashed = ((grams >> np.uint64(32)).astype(np.uint32) ^ xors[:, None]) * odds[:, None]
    keys = (hashed.astype(np.uint64) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    lows = _sliding_min(keys, width)
    for f in range(k):
        low = lows[f]
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        places = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        left, right = _ranges((low >> np.uint64(32)).tolist(), places.tolist(), len(grams))
        yield f, places, np.array(left), np.array(right)


def _windows(width: int, k: int, n: int):
    """(sign, id, lo, hi) of each window; the function's number is in the sign's lowest FUNCTION_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            parts: list[list[np.ndarray]] = [[] for _ in range(4)]
            held = 0
            for row, text in enumerate(column(batch, "text")):
                grams = shingles(word_hashes(text), n)
                for f, c, lo, hi in compact_windows(grams, width, k):
                    sign = (
                        mix(grams[c] + np.uint64((f + 1) * 0x9E3779B97F4A7C15 % 2**64)) & ~np.uint64(MAX_FUNCTIONS - 1) | np.uint64(f)
                    ).view(np.int64)
                    for part, x in zip(
                        parts, (np.full(len(c), row), sign, np.maximum(lo, c - REACH), np.minimum(hi, c + REACH) + n - 1), strict=True
                    ):
                        part.append(x)
                    held += len(c)
                if held > 200_000:
                    yield _flush(ids, parts)
                    parts, held = [[] for _ in range(4)], 0
            yield _flush(ids, parts)

    return run


def _flush(ids: pa.Array, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    row, sign, lo, hi = (np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in parts)
    if len(row):  # a row per document and signature, with the whole range in which it holds
        order = np.lexsort((sign, row))
        row, sign, lo, hi = row[order], sign[order], lo[order], hi[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (sign[1:] != sign[:-1]))))
        row, sign, lo, hi = row[first], sign[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    out = [pa.array(sign, pa.int64()), ids.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (lo, hi))]
    return pa.RecordBatch.from_arrays(out, names=["sign", "id", "lo", "hi"])


def _joined(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, lo, hi) of the unions of overlapping ranges [lo, hi] of a group, in order."""
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    wide = np.int64(hi.max(initial=0) + 2)
    reach = np.maximum.accumulate(group * wide + hi)
    first = np.flatnonzero(np.concatenate(([True], (group * wide + lo)[1:] > reach[:-1]))) if len(lo) else np.empty(0, np.int64)
    last = np.append(first[1:], len(lo)) - 1 if len(first) else first
    return group[first], lo[first], reach[last] - group[first] * wide


def agreed(
    group: np.ndarray, function: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int, agree: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, last): runs of starting places of min_words words that lie in ranges [lo, hi] of `agree` functions or more, by
    group."""
    fits = hi - lo + 1 >= min_words
    group, function, lo, last = group[fits], function[fits].astype(np.int64), lo[fits], hi[fits] - min_words + 1
    none = np.empty(0, np.int64)
    if not len(group):
        return none, none, none
    functions = int(function.max()) + 1
    own, lo, last = _joined(group * functions + function, lo, last)
    group = own // functions
    # the number of functions changes where a range begins and after it ends
    at, change = np.concatenate((lo, last + 1)), np.repeat(np.array([1, -1]), len(lo))
    group = np.concatenate((group, group))
    order = np.lexsort((change, at, group))
    group, at, count = group[order], at[order], np.cumsum(change[order])
    good = count >= agree
    begins = np.flatnonzero(good & ~np.concatenate(([False], good[:-1])))
    ends = np.flatnonzero(~good & np.concatenate(([False], good[:-1])))
    found = group[begins], at[begins], at[ends] - 1
    real = found[2] >= found[1]
    return tuple(x[real] for x in found)


def overlaid(
    group: np.ndarray, function: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int, agree: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, lo, hi): the unions of a group's overlapping ranges that hold min_words words in a row which ranges of `agree` functions
    have all."""
    inside, first, _ = agreed(group, function, lo, hi, min_words, agree)
    if not len(inside):
        return inside, first, first
    group, lo, hi = _joined(group, lo, hi)
    wide = np.int64(hi.max() + 2)
    kept = np.unique(np.searchsorted(group * wide + lo, inside * wide + first, side="right") - 1)
    return group[kept], lo[kept], hi[kept]


def _lists(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, list[dict]]:
    found: dict[int, list[dict]] = {}
    for g, a, b in zip(group.tolist(), lo.tolist(), hi.tolist(), strict=True):
        found.setdefault(g, []).append({"lo": a, "hi": b})
    return found


def _coded(column_: pa.Array) -> tuple[np.ndarray, list]:
    """(code of each value, values)."""
    if not pa.types.is_struct(column_.type):
        found = column_.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
    values: dict = {}
    codes = np.array([values.setdefault(tuple(x.items()), len(values)) for x in column_.to_pylist()], np.int64)
    return codes, [dict(v) for v in values]


FIELDS = ("id", "centre", "lo", "hi", "runs", "near", "early")


def _judge(table_: pa.Table, min_words: int, agree: int, k: int) -> pa.RecordBatch:
    """Candidates of whole documents' windows (id, centre, place), in order of ids."""
    kind = table_.schema.field("id").type
    ids, id_values = _coded(table_.column("id").combine_chunks())
    centres, centre_values = _coded(table_.column("centre").combine_chunks())
    place = table_.column("place").to_numpy().astype(np.int64).view(np.uint64)
    lo = (place >> np.uint64(33)).astype(np.int64)
    hi = lo + ((place >> np.uint64(7)) & np.uint64((1 << 26) - 1)).astype(np.int64)
    function, many = (place >> np.uint64(1) & np.uint64(63)).astype(np.int64), (place & np.uint64(1)).astype(bool)
    plain = lambda v: tuple(v.items()) if isinstance(v, dict) else v
    code = {plain(v): c for c, v in enumerate(centre_values)}
    is_own = np.array([code.get(plain(v), -1) for v in id_values], np.int64)[ids] == centres
    out: dict[str, list] = {n: [] for n in FIELDS}

    def put(*row, near: bool = False, early: list | None = None) -> None:
        for x, v in zip(out.values(), (*row, near, early), strict=True):
            x.append(v)

    own = np.flatnonzero(is_own)
    own = own[np.argsort(ids[own], kind="stable")]
    if len(own):
        first = np.flatnonzero(np.concatenate(([True], ids[own][1:] != ids[own][:-1])))
        for i, a, b in zip(
            ids[own][first].tolist(), np.minimum.reduceat(lo[own], first).tolist(), np.maximum.reduceat(hi[own], first).tolist(),
            strict=True
        ):
            put(id_values[i], id_values[i], a, b, [])
    other = np.flatnonzero(~is_own)
    pair = ids[other] * len(centre_values) + centres[other]
    for p, runs in _lists(*overlaid(pair, function[other], lo[other], hi[other], min_words, agree)).items():
        put(id_values[p // len(centre_values)], centre_values[p % len(centre_values)], runs[0]["lo"], runs[-1]["hi"], runs)
    shared = np.isin(ids, np.unique(ids[many]))
    group, first, last = agreed(ids[shared], function[shared], lo[shared], hi[shared], min_words, k)
    for i, runs in _lists(group, first, last + min_words - 1).items():
        put(id_values[i], None, runs[0]["lo"], runs[-1]["hi"], runs)

    def near(rows: np.ndarray) -> dict[int, list[dict]]:
        rare, each = rows & many, rows & shared
        some = agreed(ids[rare], np.zeros(np.count_nonzero(rare), np.int64), lo[rare], hi[rare], min_words, 1)
        several = agreed(ids[each], function[each], lo[each], hi[each], min_words, agree)
        group, first, last = (np.concatenate(x) for x in zip(some, several, strict=True))
        which = np.repeat(np.array([0, 1]), [len(some[0]), len(several[0])])
        group, first, last = agreed(group, which, first, last + min_words - 1, min_words, 2)
        return _lists(*_joined(group, first, last + min_words - 1))

    early = near(~is_own)
    for i, runs in near(np.ones(len(ids), bool)).items():
        put(id_values[i], None, runs[0]["lo"], runs[-1]["hi"], runs, near=True, early=early.get(i))
    types = [kind, kind, pa.int32(), pa.int32(), RUNS, pa.bool_(), RUNS]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], names=list(out))


def _candidates(min_words: int, agree: int, k: int, most: int = 500_000):
    """From windows in order of ids: (id, centre, lo, hi, runs) of two documents that share windows, with the candidates' ranges and their
    whole
    range; (id, id, lo, hi) of each that stands for a group; and with a null centre the ranges where all functions' windows are shared, or
    (near) those of `agree` functions, one of them by three documents or more; `early` where an earlier document stands for the windows."""

    return lambda batches: (_judge(pa.Table.from_batches(held), min_words, agree, k) for held in _whole(batches, most))


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in order of ids (the column id), put together to `most` rows or more, so that a document's rows stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("id"))
        last = ids[len(ids) - 1]
        if sum(b.num_rows for b in held) + batch.num_rows < most or ids[0] == last:
            held.append(batch)
            continue
        n = len(ids) - 1  # the last document's rows wait for the next batch
        while ids[n - 1] == last:
            n -= 1
        yield [*held, batch.slice(0, n)]
        held = [batch.slice(n)]
    if held:
        yield held


def _open(min_words: int, slack: int = 0):
    """The parts of each document's ranges that no passage found covers: (id, asked). With `slack`, a window with up to so many words beyond
    passages that lie side by side is covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = [], []
            for id_, runs, spans in zip(*(column(batch, c) for c in ("id", "runs", "spans")), strict=True):
                rest = []
                done: list[list[int]] = []
                for a, b in sorted((x["start_word"], x["end_word"]) for x in spans or ()):
                    if slack and done and a <= done[-1][1] + SHINGLE:  # passages side by side are one
                        done[-1][1] = max(done[-1][1], b)
                    else:
                        done.append([a, b])
                for r in runs:
                    at = r["lo"]
                    for a, b in ((a - slack, b + slack) for a, b in done):
                        if a > at:
                            rest.append({"lo": at, "hi": min(r["hi"], a + min_words - 2)})
                        at = max(at, b - min_words + 1)
                    rest.append({"lo": at, "hi": r["hi"]})
                if rest := [r for r in rest if r["hi"] - r["lo"] + 1 >= min_words]:
                    ids.append(id_)
                    asked.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(asked, RUNS)], names=["id", "asked"])

    return run


RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_RUNS = "array<struct<lo:int,hi:int>>"


def window_hashes(grams: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` tokens, by position, by doubling."""
    if len(grams) < width:
        return np.empty(0, np.uint64)
    whole, step, odd = grams, 1, np.uint64(0x9E3779B97F4A7C15)
    while step < width:
        on = min(step, width - step)
        whole = mix(whole[:-on] * odd + whole[on:])
        step += on
    return whole


def _exact(width: int, n: int):
    """(sign, id, lo) of each whole window in the ranges asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, signs, places = batch.column(0), [], [], []
            for row, (text, asked) in enumerate(zip(column(batch, "text"), column(batch, "asked"), strict=True)):
                whole = window_hashes(shingles(word_hashes(text), n), width)
                at = np.unique(np.concatenate([np.arange(x["lo"], min(len(whole), x["hi"] - width - n + 3)) for x in asked]))
                rows.append(np.full(len(at), row))
                signs.append(whole[at].view(np.int64))
                places.append(at)
            row, sign, lo = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (rows, signs, places))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sign), ids.take(pa.array(row)), pa.array(lo.astype(np.int32))], names=["sign", "id", "lo"]
            )

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words (32-bit hashes) of each range asked for: rows of a document that is compared, and of one that stands for a group."""
    for batch in batches:
        out: dict[str, list] = {"centre": [], "id": [], "start": [], "runs": [], "words": []}
        for id_, text, asked, lo, hi in zip(*(column(batch, c) for c in ("id", "text", "asked", "lo", "hi")), strict=True):
            words = (word_hashes(text) >> np.uint64(32)).astype(np.uint32)
            rows = [
                (x["centre"], id_, x["runs"][0]["lo"], x["runs"], x["runs"][-1]["hi"]) for x in asked or ()
            ] + ([(id_, None, lo, [], hi)] if lo is not None else [])
            for *row, last in rows:
                for x, v in zip(out.values(), (*row, words[row[2] : last + 1].tobytes()), strict=True):
                    x.append(v)
        kind = batch.schema.field("id").type
        types = [kind, kind, pa.int32(), RUNS, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], names=list(out))


def passages(mine: np.ndarray, theirs: np.ndarray, n: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start there, end there, similarity): the ranges of words of `mine` that `theirs` has too, nearly."""
    a, b = shingles(mine.astype(np.uint64), n), shingles(theirs.astype(np.uint64), n)
    if len(mine) < min_words or len(theirs) < n:
        return []
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    hit = b[order][at] == a
    if hit.sum() < similarity * (min_words - n + 1) / 2:
        return []
    there = order[at]
    follows = np.append(b[order][1:] == b[order][:-1], False)
    single = hit & ~follows[at]  # tokens that stand once in `theirs` tell where the counterpart is
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    runs = edges.reshape(-1, 2).tolist()
    found: list[tuple[int, int, int, int, float]] = []
    upto = np.concatenate(([0], np.cumsum(hit)))

    def alike(mine_set: np.ndarray, lo: int, hi: int) -> float:
        their_set = np.unique(b[lo:hi])
        both = len(np.intersect1d(mine_set, their_set, assume_unique=True))
        return both / max(1, len(mine_set) + len(their_set) - both)

    def compare(start: int, stop: int) -> tuple[float, int, int]:
        """Jaccard similarity with the counterpart, and where that is."""
        mine_set = np.unique(a[start:stop])
        spots = np.flatnonzero(single[start:stop]) + start
        if len(spots):
            shift = there[spots] - spots
            lo, hi = max(0, start + int(np.median(shift[:MAX_GAP]))), min(len(b), stop + int(np.median(shift[-MAX_GAP:])))
        else:  # nothing but repetition: its longest run
            ends = np.flatnonzero(np.diff(np.concatenate(([0], np.isin(b, mine_set).view(np.int8), [0])))).reshape(-1, 2)
            lo, hi = ends[np.argmax(ends[:, 1] - ends[:, 0])].tolist()
        score = alike(mine_set, lo, hi)
        if score < similarity and len(mine_set) < stop - start:  # a counterpart that repeats itself less often is shorter
            spots = np.flatnonzero(np.isin(b[lo:hi], mine_set))
            if len(spots):
                lo, hi = lo + int(spots[0]), lo + int(spots[-1]) + 1
                score = alike(mine_set, lo, hi)
        return score, lo, hi

    def judged(first: int, last: int) -> bool:
        start, stop = runs[first][0], runs[last][1]
        if upto[stop] - upto[start] < similarity * (stop - start):  # too few are shared
            return False
        score, lo, hi = compare(start, stop)
        if score < similarity or hi - lo + n - 1 < similarity * min_words:
            return False
        found.append((start, stop + n - 1, lo, hi + n - 1, score))
        return True

    def covered(first: int, last: int) -> None:
        """Passages of neighbouring runs, from the first on, that hold as many of the runs as can be."""
        run = first
        while run <= last:
            reach, begin = run, run
            while reach == run and begin >= first and (begin >= run - 1 or runs[run][0] - runs[begin][1] < min_words):
                start, end = runs[begin][0], last
                while end >= run:
                    stop = runs[end][1]
                    if stop - start + n - 1 < min_words:
                        break
                    # the counterpart has the n-grams over each gap's ends too
                    least = stop - start + (n - 1) * int(wide[end] - wide[begin])
                    if (begin, end) != (first, last) and upto[stop] - upto[start] >= similarity * least and judged(begin, end):
                        reach = end + 1
                        break
                    end -= 1
                begin -= 1
            run = max(reach, run + 1)

    # runs with small gaps between them, or too short to stand alone, are judged together, or else on either side of their widest gap, or,
    # where all gaps are small, in overlapping parts
    gaps = np.array([y[0] - x[1] for x, y in zip(runs, runs[1:], strict=False)], np.int64)
    wide = np.concatenate(([0], np.cumsum(gaps >= n - 1)))
    waiting = [(0, len(runs) - 1)]
    while waiting:
        first, last = waiting.pop()
        start, stop = runs[first][0], runs[last][1]
        if stop - start + n - 1 < min_words:
            continue
        if last > first:
            widest = first + int(gaps[first:last].argmax())
            alone = min(runs[widest][1] - start, stop - runs[widest + 1][0]) + n - 1 >= min_words
            if gaps[widest] > MAX_GAP and alone:
                waiting += [(first, widest), (widest + 1, last)]
                continue
        if not judged(first, last) and last > first:
            if gaps[widest] > MAX_GAP:
                waiting += [(first, widest), (widest + 1, last)]
            else:
                covered(first, last)
    return found


def _verify(n: int, min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for id_, start, runs, words, centre, first, theirs in zip(
                *(column(batch, c) for c in ("id", "start", "runs", "words", "centre", "first", "theirs")), strict=True
            ):
                mine, other = np.frombuffer(words, np.uint32), np.frombuffer(theirs, np.uint32)
                for r in runs:
                    for a, b, c, d, score in passages(mine[r["lo"] - start : r["hi"] + 1 - start], other, n, min_words, similarity):
                        for x, v in zip(out, (id_, r["lo"] + a, r["lo"] + b, centre, first + c, first + d, score), strict=True):
                            x.append(v)
            kind = batch.schema.field("id").type
            types = [kind, pa.int32(), pa.int32(), kind, pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, types, strict=True)],
                names=["id", "start_word", "end_word", "source_id", "source_start", "source_end", "similarity"]
            )

    return run


def _compared(base: DataFrame, met: DataFrame, n: int, min_words: int, similarity: float) -> DataFrame:
    """The passages that verify among the candidates (id, centre, runs) and the ranges (lo, hi) of the documents that stand for their
    groups (id = centre)."""
    kind = dict(base.dtypes)["id"]
    pairs = met.filter("id <> centre")
    own = met.filter("id = centre").select("id", "lo", "hi").join(
        checkpoint(pairs.select(F.col("centre").alias("id")).distinct()), "id", "left_semi"
    )
    asked = pairs.groupBy("id").agg(F.collect_set(F.struct("centre", "runs")).alias("asked"))
    wanted = checkpoint(asked.join(own, "id", "full").select("id", "asked", "lo", "hi"))
    regions = checkpoint(
        base.join(wanted, "id").mapInArrow(lean(_regions), f"centre {kind}, id {kind}, start int, runs {_RUNS}, words binary"), wide=True
    )
    sweep(base.sparkSession)
    theirs = regions.filter("id is null").groupBy("centre").agg(
        F.max(F.struct(F.col("start").alias("first"), F.col("words").alias("theirs"))).alias("x")
    )
    theirs = checkpoint(theirs.select("centre", "x.first", "x.theirs"))
    faced = regions.filter("id is not null").join(theirs, "centre").select("id", "start", "runs", "words", "centre", "first", "theirs")
    schema = f"id {kind}, start_word int, end_word int, source_id {kind}, source_start int, source_end int, similarity double"
    found = checkpoint(faced.mapInArrow(lean(_verify(n, min_words, similarity)), schema).distinct())
    sweep(base.sparkSession)
    return found


def _left_over(base: DataFrame, met: DataFrame, found: DataFrame, n: int, min_words: int) -> DataFrame:
    """Exact passages by the hash of whole windows, where all functions' windows are shared but `found` leaves them open."""
    spark, kind = base.sparkSession, dict(base.dtypes)["id"]
    spans = found.groupBy("id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    ranges = met.filter("centre is null and not near").select("id", "runs").join(checkpoint(spans), "id", "left")
    asked = checkpoint(ranges.mapInArrow(lean(_open(min_words)), f"id {kind}, asked {_RUNS}"))
    texts = base.join(asked, "id").select("id", "text", "asked")
    rows = checkpoint(texts.mapInArrow(lean(_exact(min_words - n + 1, n)), f"sign bigint, id {kind}, lo int"))
    sweep(spark)
    # the first place of a window is in the document with the smallest id
    groups = rows.groupBy("sign").agg(F.min(F.struct("id", "lo")).alias("at"), F.max("id").alias("last")).filter("at.id < last")
    groups = checkpoint(groups.select("sign", F.col("at.id").alias("centre"), F.col("at.lo").alias("there")))
    linked = checkpoint(rows.join(groups, "sign").filter("id <> centre").select("id", "centre", "lo", "there"))
    sweep(spark)
    # neighbouring windows with the same counterpart are one passage; the rows of a document are bounded by its words
    along = Window.partitionBy("id", "centre", F.col("there") - F.col("lo")).orderBy("lo")
    passages_ = linked.withColumn("part", F.col("lo") - F.row_number().over(along)).groupBy(
        "id", "centre", (F.col("there") - F.col("lo")).alias("shift"), "part"
    )
    spots = passages_.agg(F.min("lo").alias("a"), (F.max("lo") + min_words).alias("b"))
    there = (F.col("a") + F.col("shift"), F.col("b") + F.col("shift"))
    return checkpoint(
        spots.select(
            "id", F.col("a").alias("start_word"), F.col("b").alias("end_word"), F.col("centre").alias("source_id"),
            there[0].alias("source_start"), there[1].alias("source_end"), F.lit(1.0).alias("similarity")
        )
    )


FILTER_BITS = 1 << 26


def _bits(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits (8 MB, whatever the input) of the grams. It only saves work: what it lets through is joined, and a
    full one lets all through."""
    spots = F.explode(F.array(F.pmod("gram", F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned("gram", 32), F.lit(FILTER_BITS)))).alias("p")
    words = grams.filter("gram is not null").select(spots).groupBy(F.expr("p div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")
    ).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _passing(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask = np.uint64(FILTER_BITS - 1)
    spots = (grams & mask, (grams >> np.uint64(32)) & mask)
    return np.logical_and(*((bits[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool) for x in spots))


def _before(grams: np.ndarray, width: int) -> np.ndarray:
    """The place before each where its gram is, -width if there is none."""
    order = np.argsort(grams, kind="stable")
    before = np.full(len(grams), -width)
    same = grams[order][1:] == grams[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    return before


def _firsts(places: np.ndarray, before: np.ndarray, size: int, width: int) -> np.ndarray:
    """For the windows that start at 0 to size - 1, how many of the places they hold first of their kind: these start after the one before."""
    begins = np.bincount(np.clip(np.maximum(before + 1, places - width + 1), 0, size), minlength=size + 1)
    return np.cumsum(begins - np.bincount(np.minimum(places + 1, size), minlength=size + 1))[:size]


def spared(before: np.ndarray, width: int, alike: int, similarity: float) -> np.ndarray:
    """How many grams may differ of the window that starts at each place, where another is as similar: width - alike, and less where repetition
    leaves few different grams (one more, as windows may lie a little apart)."""
    different = _firsts(np.arange(len(before)), before, len(before), width)
    return np.minimum(width - alike, np.floor((1 - similarity) * different + 1e-9).astype(np.int64) + 1)


def _roots(again: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each place whose gram is there again, where that began; -1 for others."""
    root = np.where(again, before, np.arange(len(before)))
    while again[root].any():
        root = root[root]
    return np.where(again, root, -1)


def _spelt(width: int, n: int):
    """The 5-grams of each document's ranges and of a window before them, from the place `start` on: (id, start, grams, runs, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, grams = [], []
            for text, runs in zip(*(column(batch, c) for c in ("text", "runs")), strict=True):
                starts.append(max(0, runs[0]["lo"] - width))
                grams.append(shingles(word_hashes(text), n)[starts[-1] : runs[-1]["hi"] - n + 2].tobytes())
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "runs", "asked")]
            yield pa.RecordBatch.from_arrays(
                [rest[0], pa.array(starts, pa.int32()), pa.array(grams, pa.binary()), *rest[1:]], names=["id", "start", "grams", "runs", "asked"]
            )

    return run


def _inside(runs: list[dict], start: int, size: int, less: int) -> np.ndarray:
    """Whether each place from `start` on lies in the ranges, without their last `less` words."""
    found = np.zeros(size, bool)
    for r in runs:
        found[max(0, r["lo"] - start) : max(0, r["hi"] - less + 1 - start)] = True
    return found


PART = 3


def _some(n: int):
    """(gram, id, at) of a third of the places in a document's ranges, the same grams everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(3)]
            for row, (start, held, runs) in enumerate(zip(*(column(batch, c) for c in ("start", "grams", "runs")), strict=True)):
                grams = np.frombuffer(held, np.uint64)
                at = np.flatnonzero(_inside(runs, start, len(grams), n - 1) & (grams % np.uint64(PART) == 0))
                names, first = np.unique(grams[at], return_index=True)
                for part, x in zip(parts, (np.full(len(first), row), names.view(np.int64), at[first] + start), strict=True):
                    part.append(x)
            row, gram, at = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), batch.column(batch.schema.get_field_index("id")).take(pa.array(row)), pa.array(at.astype(np.int32))],
                names=["gram", "id", "at"]
            )

    return run


def _grams(width: int, n: int, alike: int, similarity: float, shared=None):
    """(gram, id, at, more, spare, root) of each place in a document's ranges, or (`more`) so many more with the same; `spare`: how many grams may differ of the window that starts there, null
    if it is not whole in them. Places of windows with more places than that among the `missing` are left out. A 5-gram that was there less
    than a window before, in the ranges, has no gram, but the place where that began (`root`). With `shared`, a broadcast filter, the places
    of windows of which it lets `alike` grams through: a 5-gram that was there less than a window before, wherever, has neither, and neither
    agrees nor differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            for row, (start, held, runs, missing) in enumerate(
                zip(*(column(batch, c) for c in ("start", "grams", "runs", "missing")), strict=True)
            ):
                grams = np.frombuffer(held, np.uint64)
                before = _before(grams, width)
                again = np.arange(len(grams)) - before < width
                wanted = _inside(runs, start, len(grams), n - 1)

                def of_windows(good: np.ndarray) -> np.ndarray:
                    """The places of the windows that start at the places marked."""
                    upto = np.cumsum(np.concatenate((np.zeros(width, np.int64), good)))  # noqa: B023
                    return upto[width:] > upto[:-width]

                if shared is None:
                    spare = np.where(_inside(runs, start, len(grams), width + n - 2), spared(before, width, alike, similarity), -1)
                    lacks = np.zeros(len(grams) + width, np.int64)
                    lacks[np.array(missing or [], np.int64) - start] = 1
                    upto = np.concatenate(([0], np.cumsum(lacks)))
                    spare[upto[width:-1] - upto[: -width - 1] > spare] = -1
                    wanted &= of_windows(np.append(spare >= 0, False))[: len(grams)]
                    again &= wanted[before]
                    root = _roots(again, before)
                else:
                    spare, root = np.full(len(grams), width - alike), np.full(len(grams), -1 - start)
                    wanted &= again | _passing(grams, shared.value)
                    upto = np.concatenate(([0], np.cumsum(np.concatenate((wanted, np.zeros(width, bool))))))
                    wanted &= of_windows(upto[width:] - upto[:-width] >= alike)[: len(wanted)]
                    if not (wanted & ~again).any():
                        continue
                at = np.flatnonzero(wanted)
                on = (np.diff(at) == 1) & again[at[1:]] & again[at[:-1]]
                first = np.flatnonzero(np.append(True, ~(on & (spare[at[1:]] == spare[at[:-1]]) & (root[at[1:]] == root[at[:-1]]))))
                first = first[: len(at)]
                more, at = np.diff(np.append(first, len(at))) - 1, at[first]
                for part, x in zip(
                    parts, (np.full(len(at), row), grams[at].view(np.int64), at + start, more, again[at], spare[at], root[at] + start),
                    strict=True
                ):
                    part.append(x)
            row, gram, at, more, again, spare, root = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram, mask=again.astype(bool)), ids.take(pa.array(row)), pa.array(at.astype(np.int32)),
                    pa.array(more.astype(np.int32)), pa.array(spare.astype(np.int32), mask=spare < 0),
                    pa.array(root.astype(np.int32), mask=~again.astype(bool))
                ], names=["gram", "id", "at", "more", "spare", "root"]
            )

    return run


MARKS = ("id", "gram", "times", "lo", "hi", "runs")
WINDOWS_AT_ONCE = 1 << 15
GROWTH = 8


def rare_grams(
    at: np.ndarray, gram: np.ndarray, times: np.ndarray, spare: np.ndarray, root: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's shared grams by place (`times` 0: as at `root`, or unknown if that is below 0, so that it neither agrees nor differs):
    the starts of the windows of `width` places that lack at most `spare` (of their first place; below 0: none starts there); and the grams
    among the rarest spare + 1 of any of them, with the first and the last of their windows."""
    free = times == 0
    base = int(at[0])
    size = max(int(at[-1]) - base + 1, width)
    may, absent = np.full(size, -1), np.ones(size, bool)
    may[at - base], absent[at - base] = spare, False
    differ = np.cumsum(np.concatenate(([0], absent)))
    lacking = differ[width:] - differ[:-width]
    own = free & (root >= 0) & ~np.isin(root, at[~free])  # repeated, and not shared
    if own.any():
        places, roots = at[own] - base, root[own] - base
        order = np.lexsort((places, roots))
        places, before = places[order], roots[order]
        along = np.flatnonzero(before[1:] == before[:-1]) + 1
        before[along] = places[along - 1]
        lacking += _firsts(places, before, len(lacking), width)
    good = np.flatnonzero(lacking <= may[: len(lacking)])
    if not len(good):
        none = np.empty(0, np.int64)
        return none, none, none, none
    names, code = np.unique(gram, return_inverse=True)
    often = np.zeros(len(names), np.int64)
    np.maximum.at(often, code, times)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, often))] = np.arange(len(names))
    none = len(names)
    line = np.full(size, -1, np.int32)
    line[at - base] = np.where(free, none, rank[code])
    by_rank = names[np.argsort(rank)]
    few = int(spare.max()) + 1
    first, last, bare = np.full(none, size), np.full(none, -1), np.zeros(size + 1, bool)
    views = np.lib.stride_tricks.sliding_window_view(line, width)
    for a in range(0, len(good), WINDOWS_AT_ONCE):
        part = good[a : a + WINDOWS_AT_ONCE]
        least = np.sort(np.partition(views[part], few - 1, axis=1)[:, :few], axis=1)
        least[np.arange(few) > may[part][:, None]] = -1
        least = least.ravel()
        real = (least >= 0) & (least < none)
        place = np.repeat(part, few)[real]
        np.minimum.at(first, least[real], place)
        np.maximum.at(last, least[real], place)
        bare[part[~real.reshape(-1, few).any(axis=1)]] = True
    kept = np.flatnonzero(last >= 0)
    # windows of nothing but repetition go with those beside them
    ends = np.flatnonzero(~bare)
    last[kept] = ends[np.searchsorted(ends, last[kept] + 1)] - 1
    first[kept] = np.append(-1, ends)[np.searchsorted(ends, first[kept])] + 1
    return good + base, by_rank[kept], first[kept] + base, last[kept] + base


def _rare(width: int, n: int, whole: bool):
    """From places with shared grams in order of ids: (id, gram, lo, hi) of the grams by which documents are paired, with the first and the
    last start of their windows; without gram, the ranges (lo, hi: the whole of it) of the windows that may have a counterpart, and those
    windows' runs; and, if `whole`, with neither, all grams in such windows, with how often they are there."""

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        kind = rows.schema.field("id").type
        ids, values = _coded(rows.column("id").combine_chunks())
        gram = rows.column("gram").fill_null(0).to_numpy()
        at, times, spare, root = (rows.column(c).fill_null(-1).to_numpy() for c in ("at", "times", "spare", "root"))
        each = np.repeat(np.arange(len(at)), rows.column("more").to_numpy() + 1)
        begin = np.append(True, each[1:] != each[:-1])[: len(each)]
        along = np.arange(len(each)) - np.maximum.accumulate(np.where(begin, np.arange(len(each)), 0))
        ids, gram, at, times, spare, root = (x[each] for x in (ids, gram, at, times, spare, root))
        at = at + along
        out: dict[str, list] = {c: [] for c in MARKS}

        def put(*row: list) -> None:
            for x, v in zip(out.values(), row, strict=True):
                x += v

        edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if not times[a:b].any() or spare[a:b].max() < 0:
                continue
            starts, grams, lo, hi = rare_grams(at[a:b].astype(np.int64), gram[a:b], times[a:b], spare[a:b], root[a:b], width)
            if not len(starts):
                continue
            id_, words = values[ids[a]], width + n - 2
            runs = _joined(np.zeros(len(starts), np.int64), starts, starts + words)[1:]
            own = [{"lo": x, "hi": y} for x, y in zip(*(x.tolist() for x in runs), strict=True)]
            put([id_], [None], [None], [max(0, int(starts[0]) - REACH)], [int(starts[-1]) + words + REACH], [own])
            m = len(grams)
            put([id_] * m, grams.tolist(), [None] * m, lo.tolist(), hi.tolist(), [None] * m)
            if whole:
                inside = np.searchsorted(runs[0], at[a:b], side="right") - 1
                inside = (inside >= 0) & (at[a:b] <= runs[1][inside] - n + 1) & (times[a:b] > 0)
                held_, spot = np.unique(gram[a:b][inside], return_index=True)
                m = len(held_)
                put([id_] * m, held_.tolist(), times[a:b][inside][spot].tolist(), [None] * m, [None] * m, [None] * m)
        types = [kind, pa.int64(), pa.int64(), pa.int32(), pa.int32(), RUNS]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], names=list(out))

    return lambda batches: (judge(held) for held in _whole(batches, 200_000))


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of passages in order of ids and sources those with a word that none of the document's passages before them has."""
    for held in _whole(batches, 50_000):
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = _coded(rows.column("id").combine_chunks())[0].tolist()
        kept, before, spans = [], None, []
        for i, (id_, a, b) in enumerate(zip(ids, rows.column("start_word").to_pylist(), rows.column("end_word").to_pylist(), strict=True)):
            spans, before = spans if id_ == before else [], id_
            at = a
            for lo, hi in spans:  # in order, without overlaps
                if lo <= at < hi:
                    at = hi
            if at < b:
                kept.append(i)
                wide = [x for x in spans if x[0] <= b and x[1] >= a]
                one = (min([a, *(x[0] for x in wide)]), max([b, *(x[1] for x in wide)]))
                spans = sorted([*(x for x in spans if x not in wide), one])
        yield from rows.take(kept).combine_chunks().to_batches()


def _hidden(base: DataFrame, met: DataFrame, found: DataFrame, n: int, min_words: int, similarity: float) -> DataFrame:
    """Near passages between documents that share windows, but with an even earlier document too, so that they were not compared: pairs by
    their rarest grams, where `found` leaves a place open."""
    spark, kind, width = base.sparkSession, dict(base.dtypes)["id"], min_words - n + 1
    # sets of one size with that similarity have as many 5-grams in common; one less, as windows may lie a little apart
    alike = ceil(2 * similarity / (1 + similarity) * width) - 1
    slack = min_words - ceil(similarity * min_words)
    spans = lambda x: checkpoint(x.groupBy("id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")))
    still = lambda x, y: x.join(spans(y), "id", "left").mapInArrow(lean(_open(min_words, slack)), f"id {kind}, asked {_RUNS}")
    ranges = met.filter("near and early is not null").select("id", F.col("early").alias("runs"))
    asked = checkpoint(still(ranges, found))
    places = base.join(met.filter("near").select("id", "runs").join(asked, "id", "left"), "id").select("id", "text", "runs", "asked")
    spelt, spelt_path = _kept(
        places.mapInArrow(lean(_spelt(width, n)), f"id {kind}, start int, grams binary, runs {_RUNS}, asked {_RUNS}"), "spelt"
    )
    later_ones = spelt.filter("asked is not null").select("id", "start", "grams", F.col("asked").alias("runs"))
    # a third of the grams tells most windows that lack too many
    some = f"gram bigint, id {kind}, at int"
    firsts = spelt.select("id", "start", "grams", "runs").mapInArrow(lean(_some(n)), some).groupBy("gram").agg(
        F.min("id").alias("first"), F.max("id").alias("last")
    )
    firsts = checkpoint(firsts.filter("first < last").select("gram", "first"))
    some_rows, some_path = _kept(later_ones.mapInArrow(lean(_some(n)), some), "grams")
    known_too = (some_rows["gram"] == firsts["gram"]) & (firsts["first"] < some_rows["id"])
    missing = checkpoint(some_rows.join(firsts, known_too, "left_anti").groupBy("id").agg(F.collect_list("at").alias("missing")))
    _remove(spark, some_path)
    sweep(spark)
    schema = f"gram bigint, id {kind}, at int, more int, spare int, root int"
    late_rows, late_path = _kept(later_ones.join(missing, "id", "left").mapInArrow(lean(_grams(width, n, alike, similarity)), schema), "grams")
    shared = spark.sparkContext.broadcast(_bits(late_rows.select("gram")))
    near_ones = spelt.select("id", "start", "grams", "runs", F.expr("cast(null as array<int>)").alias("missing"))
    rows, path = _kept(near_ones.mapInArrow(lean(_grams(width, n, alike, similarity, shared)), schema), "grams")
    _remove(spark, spelt_path)
    marked = lambda x, whole: checkpoint(
        x.select("id", "at", "more", "spare", "root", "gram", "times").repartition("id").sortWithinPartitions("id", "at").mapInArrow(
            lean(_rare(width, n, whole)), f"id {kind}, gram bigint, times bigint, lo int, hi int, runs {_RUNS}"
        )
    )
    free = lambda x: x.filter("gram is null").withColumn("times", F.lit(0).cast("bigint"))
    # a later document's open windows agree with an earlier one in grams that an earlier one has
    known = rows.filter("gram is not null").groupBy("gram").agg(F.count("*").alias("times"), F.min("id").alias("first"))
    known = checkpoint(known)
    sweep(spark)
    later = marked(
        late_rows.join(known, "gram").filter("first < id").unionByName(free(late_rows), allowMissingColumns=True), True
    )
    _remove(spark, late_path)
    # and an earlier one with a later one in those of its windows that are left
    sought = later.filter("times is not null").groupBy("gram").agg(F.max("times").alias("times"), F.max("id").alias("last"))
    sought = checkpoint(sought)
    sweep(spark)
    facing = rows.join(sought, "gram").filter("id < last").drop("last").unionByName(free(rows))
    earlier = marked(facing, False)
    _remove(spark, path)
    sweep(spark)
    along = Window.partitionBy("gram").orderBy("id")
    sources = earlier.filter("gram is not null").select("gram", F.col("id").alias("centre"), F.row_number().over(along).alias("rank"))
    sources = checkpoint(sources.join(later.filter("lo is not null").select("gram").distinct(), "gram", "left_semi"))
    last = sources.agg(F.max("rank")).first()[0] or 0
    wholes = earlier.filter("runs is not null").select("id", F.col("id").alias("centre"), "lo", "hi", F.expr(f"cast(array() as {_RUNS})").alias("runs"))
    keys = later.filter("lo is not null and gram is not null").select("gram", "id", "lo", "hi")
    texts = checkpoint(base.join(checkpoint(keys.select("id").union(wholes.select("id")).distinct()), "id"), wide=True)
    # earlier documents come in growing parts, so that the many that have the same passage leave after the first
    asked, least, parts = later.filter("runs is not null").select("id", "runs"), 1, []
    # of what is open, that of the windows by which the two are paired; a passage may reach beyond these
    near = lambda x: (x["lo"] <= F.col("b") + min_words - 1) & (x["hi"] >= F.col("a"))
    wider = lambda x: F.struct(
        F.greatest(x["lo"] - MAX_GAP, F.col("a") - MAX_GAP, F.lit(0)).alias("lo"),
        F.least(x["hi"] + MAX_GAP, F.col("b") + (min_words - 1 + MAX_GAP)).alias("hi")
    )
    while least <= last:
        still_open = F.exists("runs", lambda x: (x["lo"] <= F.col("hi")) & (x["hi"] - (min_words - 1) >= F.col("lo")))
        keys = checkpoint(keys.join(asked, "id").filter(still_open).drop("runs"))
        pairs = keys.join(sources.filter(F.col("rank").between(least, least * GROWTH)), "gram").filter("centre < id")
        pairs = checkpoint(pairs.groupBy("id", "centre").agg(F.min("lo").alias("a"), F.max("hi").alias("b")))
        sweep(spark)
        compared = pairs.join(asked, "id").select(
            "id", "centre", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"),
            F.transform(F.filter("runs", near), wider).alias("runs")
        ).filter("size(runs) > 0")
        least = least * GROWTH + 1
        if pairs.isEmpty():
            continue
        agreed_ = _compared(texts, checkpoint(compared.unionByName(wholes)), n, min_words, similarity)
        agreed_ = agreed_.repartition("id").sortWithinPartitions("id", "source_id", "start_word", "end_word")
        parts.append(checkpoint(agreed_.mapInArrow(lean(_adding), agreed_.schema)))
        asked = checkpoint(still(asked, parts[-1]).select("id", F.col("asked").alias("runs")))
    out = parts[0] if parts else found.limit(0)
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written once in the shared folder as Parquet, and its path: it is deleted after use."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool, str | None]:
    """(id, text) of the rows with an id, each once, and the path of what had to be written for it. Where an id stands for different texts,
    ids become (id, hash of the text), so rows are told apart."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    hashed = F.xxhash64("text")
    twice = base.select("id", hashed.alias("h")).groupBy("id").agg(
        F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n")
    ).filter("n > 1")
    rows, differ = twice.agg(F.count("*"), F.count_if(F.col("a") != F.col("b"))).first()
    if not rows:
        return base, False, None
    base, path = _kept(base.withColumn("h", hashed).groupBy("id", "h").agg(F.min("text").alias("text")), "documents")
    return base.select(F.struct("id", "h").alias("id") if differ else "id", "text"), bool(differ), path


def _found(base: DataFrame, written: str | None, min_words: int, n: int, similarity: float, recall: float, agree: int) -> DataFrame:
    spark = base.sparkSession
    ship(spark)
    k, width = hash_count(similarity, recall, agree), min_words - n + 1
    kind = dict(base.dtypes)["id"]
    # windows are read twice, and hashing costs far more than reading
    windows, path = _kept(base.mapInArrow(lean(_windows(width, k, n)), f"sign bigint, id {kind}, lo int, hi int"), "windows")
    # a side that is written first, not summed up in the join's own stage, lets adaptive execution split a hot key's rows
    groups = windows.groupBy("sign").agg(
        F.min("id").alias("centre"), F.max("id").alias("last"), (F.count("*") > 2).alias("many")
    ).filter("centre < last")
    groups = checkpoint(groups.select("sign", "centre", "many"))
    sweep(spark)
    # a window's range, function and whether three documents have it, in one number
    parts = {
        "shiftleft(cast(lo as bigint), 33)", f"shiftleft(least(cast(hi - lo as bigint), {(1 << 26) - 1}L), 7)",
        f"shiftleft(sign & {MAX_FUNCTIONS - 1}L, 1)", "cast(many as bigint)"
    }
    hits = windows.join(groups, "sign").select(
        "id", "centre", F.expr(" | ".join(sorted(parts))).alias("place")
    ).repartition("id").sortWithinPartitions("id")
    met = checkpoint(hits.mapInArrow(lean(_candidates(min_words, agree, k)), f"id {kind}, centre {kind}, lo int, hi int, runs {_RUNS}, near boolean, early {_RUNS}"))
    _remove(spark, path)
    sweep(spark)
    found = _compared(base, met, n, min_words, similarity)
    found = found.unionByName(_left_over(base, met, found, n, min_words))
    found = found.unionByName(_hidden(base, met, found, n, min_words, similarity))
    if written:
        _remove(spark, written)
    return found.distinct()


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, n: int = SHINGLE,
    similarity: float = SIMILARITY, recall: float = TARGET_RECALL, agree: int = AGREE
) -> DataFrame:
    """One row per passage (id, start_word, end_word) that a document with a smaller id (source_id) has too, with its place there. Words
    are counted from 0; ends are exclusive."""
    base, by_text, written = _keyed(docs, id_col, text_col)
    found = _found(base, written, min_words, n, similarity, recall, agree)
    if by_text:
        found = found.withColumn("id", F.col("id.id")).withColumn("source_id", F.col("source_id.id")).distinct()
    return found.withColumnRenamed("id", id_col)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words."""
    ends = [m.span() for m in re.finditer(r"\S+", text)]
    kept, at = [], 0
    for a, b in sorted(spans):
        a, b = max(a, at), min(b, len(ends))
        if b > a:
            kept.append(text[ends[at][0] : ends[a - 1][1]] if a > at else "")
            at = b
    if at < len(ends):
        kept.append(text[ends[at][0] if at else 0 :])
    return "\n".join(x for x in kept if x)


def _cut(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*((x.as_py() for x in batch.column(at)) for at in (text_at, spans_at)), strict=True)
            texts = [t if not spans else cut(t or "", [(x["start_word"], x["end_word"]) for x in spans]) for t, spans in rows]
            yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = MIN_WORDS, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, agree: int = AGREE
) -> DataFrame:
    """docs without the passages that an earlier document has; a document of which no word is left goes. chars_col is counted anew where a
    text changes."""
    base, by_text, written = _keyed(docs, id_col, text_col)
    key, spans = unused(docs, "key"), unused(docs, "spans")
    found = _found(base, written, min_words, n, similarity, recall, agree).groupBy(F.col("id").alias(key)).agg(
        F.collect_set(F.struct("start_word", "end_word")).alias(spans)
    )
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")) if by_text else F.col(id_col)
    both = docs.withColumn(key, own).join(found, key, "left").select(*docs.columns, spans)
    done = both.mapInArrow(lean(_cut(both.columns.index(text_col), len(both.columns) - 1)), both.schema)
    done = done.filter(F.col(spans).isNull() | (F.trim(F.col(text_col)) != ""))
    if chars_col in docs.columns:
        counted = F.when(F.col(spans).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
        done = done.withColumn(chars_col, counted)
    return done.select(*docs.columns)


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document has too."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("source_id", "source_doc_id")
