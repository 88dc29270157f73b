"""Benchmark decontamination by greedy string tiling.

Seeds (runs of MIN_TILE tokens that a text shares with a benchmark item) join texts to items; a pair goes on only if its seeds
could reach the threshold. Greedy string tiling then marks, again and again, the longest matches between unmarked tokens, found by
running Karp-Rabin hashes, so that reordered parts of an item all count. An item whose tokens are covered by tiles to at least
COVERAGE contaminates the text.

The benchmark is broadcast only in parts of at most PART_WORDS words (about 32 MB of hashes): a larger one takes a pass over the
texts for each part. Nothing else goes to the driver, and texts are never shuffled. A text's distinct seeds are looked up CHUNK
entries of the index at a time and only mark the items' words, so a text takes memory in proportion to itself and to a part of the
benchmark, however often either repeats itself; items are judged one by one.

Tokens are runs of letters, digits and underscores in lower case, so punctuation and case don't matter. Defined results: null or
empty texts match nothing, texts of any length are read whole; items that are null or under MIN_TILE tokens are never matched; null ids
are kept as ids; repeated rows each give their own result; equal items each match; of equally long matches the earliest in the item is
marked first. An empty table gives no rows, an empty benchmark matches nothing; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.llm.common import column, lean, shingles, ship, table, word_hashes

MIN_TILE = 5
COVERAGE = 0.5
PART_WORDS = 4_000_000
CHUNK = 1 << 18
_OTHER = re.compile(r"\W+")
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def tokens(text: str | None) -> np.ndarray:
    return word_hashes(_OTHER.sub(" ", text or ""))


class _Rolling:
    """Karp-Rabin hashes modulo 2**64 of the windows of any length, from one running sum."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers[:-1], dtype=np.uint64)))
        self.size = n

    def windows(self, length: int) -> np.ndarray:
        starts = self.size - length + 1
        return (self.sums[length:] - self.sums[:starts]) * self.back[:starts]


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first; ties go to the earliest place in the item, then in the
    text. No token is in two tiles."""
    marks = [np.zeros(len(item), bool), np.zeros(len(text), bool)]
    rolling = [_Rolling(item), _Rolling(text)]

    def free(which: int, length: int) -> np.ndarray:
        taken = np.concatenate(([0], np.cumsum(marks[which])))
        return np.flatnonzero(taken[length:] == taken[: len(taken) - length])

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = free(0, length), free(1, length)
        x, y = rolling[0].windows(length)[a], rolling[1].windows(length)[b]
        keep = np.isin(x, y)
        return a[keep], x[keep], b, y

    found, limit = [], min(len(item), len(text))
    while limit >= least:
        low, high = least - 1, limit  # the longest match: if there's one of a length, there's one of each shorter length
        while low < high:
            middle = (low + high + 1) // 2
            if len(matches(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        limit = low
        a, x, b, y = matches(low)
        places: dict[int, list[int]] = {}
        inside = np.isin(y, x)
        for j, h in zip(b[inside].tolist(), y[inside].tolist(), strict=True):
            places.setdefault(h, []).append(j)
        for i, h in zip(a.tolist(), x.tolist(), strict=True):
            if marks[0][i : i + low].any():
                continue
            for j in places[h]:
                if not marks[1][j : j + low].any() and np.array_equal(item[i : i + low], text[j : j + low]):
                    marks[0][i : i + low] = marks[1][j : j + low] = True
                    found.append((i, j, low))
                    break
        if not found or found[-1][2] != low:  # hashes that met without equal tokens
            limit = low - 1
    return found


class Items:
    """An index of a part of the benchmark by seed."""

    def __init__(self, rows: list[tuple], least: int):
        self.ids = [r[0] for r in rows]
        self.words = [tokens(r[1]) for r in rows]
        grams = [shingles(w, least) if len(w) >= least else np.empty(0, np.uint64) for w in self.words]
        seeds = np.concatenate([*grams, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]

        self.starts = np.cumsum([0, *map(len, self.words)])

    def _seeded(self, seeds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, number of their words that are in one of the text's distinct seeds). The seeds' entries are marked in chunks."""
        first = np.searchsorted(self.seeds, seeds, side="left")
        count = np.searchsorted(self.seeds, seeds, side="right") - first
        ends = np.cumsum(count)
        if ends[-1] <= CHUNK:
            rows = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
            words = np.unique((self.starts[self.owner[rows]] + self.place[rows])[:, None] + np.arange(least))
        else:
            marks = np.zeros(int(self.starts[-1]) + 1, np.int32)
            for a in range(0, int(ends[-1]), CHUNK):
                entry = np.arange(a, min(a + CHUNK, int(ends[-1])))
                which = np.searchsorted(ends, entry, side="right")
                rows = first[which] + entry - (ends[which] - count[which])
                spot = self.starts[self.owner[rows]] + self.place[rows]
                np.add.at(marks, spot, 1)
                np.add.at(marks, spot + least, -1)
            words = np.flatnonzero(np.cumsum(marks) > 0)
        return np.unique(np.searchsorted(self.starts, words, side="right") - 1, return_counts=True)

    def matched(self, words: np.ndarray, least: int, coverage: float) -> Iterator[tuple]:
        """(item's id, share covered, number of tiles, longest tile) of each item that the text holds."""
        if len(words) < least or not len(self.seeds):
            return
        grams = shingles(words, least)
        lo = np.searchsorted(self.seeds, grams)
        lo[lo == len(self.seeds)] = 0
        hit = self.seeds[lo] == grams
        if not hit.any():
            return
        for i, covered in zip(*(x.tolist() for x in self._seeded(np.unique(grams[hit]), least)), strict=True):
            item = self.words[i]
            if covered < coverage * len(item):
                continue
            at = np.flatnonzero(np.isin(grams, shingles(item, least)))
            found = tiles(item, self._near(words, at, least), least)
            share = sum(t[2] for t in found) / len(item)
            if share >= coverage:
                yield self.ids[i], share, len(found), max(t[2] for t in found)

    @staticmethod
    def _near(words: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
        """The tokens in seeds; runs of them are parted by a token that no text has."""
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
        parts = []
        for i, r in enumerate(runs):
            parts += [words[r[0] : r[-1] + least], np.array([i], np.uint64)]
        return np.concatenate(parts)


def _match(items, least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.value
        for batch in batches:
            rows, out = [], [[] for _ in range(4)]
            for i, text in enumerate(column(batch, "text")):
                for match in index.matched(tokens(text), least, coverage):
                    rows.append(i)
                    for x, v in zip(out, match, strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                names=["id", "item_id", "coverage", "n_tiles", "longest_tile"],
            )

    return run


def _parts(benchmark: DataFrame, item_col: str, item_text: str, least: int, part_words: int) -> Iterator:
    """The benchmark's index as broadcasts of bounded size."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (2 * part_words)))  # a token and its gap take two characters at least
    for p in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        yield benchmark.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], least))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", least: int = MIN_TILE, coverage: float = COVERAGE, part_words: int = PART_WORDS
) -> DataFrame:
    """One row per text and benchmark item that it holds: id, item_id, coverage (share of the item's tokens in tiles), n_tiles,
    longest_tile."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(base.dtypes)['id']}, item_id bigint, coverage double, n_tiles int, longest_tile int"
    found = None
    for index in _parts(benchmark, item_col, item_text, least, part_words):
        part = base.mapInArrow(lean(_match(index, least, coverage)), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col)


def _clean(items, text_col: str, least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.value
        for batch in batches:
            yield batch.filter(
                pa.array([next(index.matched(tokens(t), least, coverage), None) is None for t in column(batch, text_col)], pa.bool_())
            )

    return run


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    least: int = MIN_TILE, coverage: float = COVERAGE, part_words: int = PART_WORDS
) -> DataFrame:
    """The rows of docs that hold no benchmark item, in one pass for each part of the benchmark and without a shuffle."""
    ship(docs.sparkSession)
    for index in _parts(benchmark, item_col, item_text, least, part_words):
        docs = docs.mapInArrow(lean(_clean(index, text_col, least, coverage)), docs.schema)
    return docs


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
