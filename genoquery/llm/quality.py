"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are binned by quantiles of the training rows; trees grow level by level from histograms of
gradients and are stored as flat arrays, which a batch of rows walks through together.

Training rows are at most `per_class` rows of each label, those with the smallest hash of their id (a fixed, documented sample),
never held-out ones. Only their statistics reach the driver: 2 * per_class rows of len(STATISTICS) numbers, whatever the input;
of documents that repeat a sampled id the one with the least statistics is learnt from.

Defined results: a null or empty text has statistics of 0 and a score like any other; a text of any length is measured whole. Labels that
are
null are skipped; of labels that differ for one id the smaller counts. With one class only, or without labels, the score is the share of
label 1 (0.5 without). Ids may be null or repeat: each row is scored from its text alone. Of splits with equal gain the one of the first
statistic and the lowest cut is taken. An empty table gives no rows; other columns, whatever their names, are left out (`score`) or kept
as they are (`keep_good`).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.llm.common import column, held_out, lean, ship, table

PER_CLASS = 4000
THRESHOLD = 0.3
STATISTICS = (
    "log_chars", "log_words", "word_mean", "word_sd", "word_longest", "distinct_words", "top_word", "repeated_neighbour",
    "upper", "lower", "digit", "space", "punctuation", "symbol", "pipe", "bang", "upper_words", "capital_words", "lone_symbol_words",
    "symbol_tail_words", "words_per_stop", "lines", "distinct_lines", "line_words", "worst_line_symbols", "compressed", "entropy", "distinct_pairs",
)
_CLASS = np.zeros(256, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~"]] = 6
_CLASS[128:] = 7
_TAIL = frozenset("#$%&*+/<=>@[]\\^_`{|}~!")


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for one whole text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=count, minlength=8) / len(raw)
    share = count[count > 0] / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int32, n)
    seen = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    stops = count[46] + count[33] + count[63]
    worst = max(sum(map(x.count, "#$%&*|!")) / len(x) for x in lines) if lines else 0.0
    return [
        np.log1p(len(text)), np.log1p(n), sizes.mean(), sizes.std(), sizes.max(), len(seen) / n, max(seen.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        kinds[3], kinds[4] + kinds[7], kinds[2], kinds[1], kinds[5], kinds[6], count[124] / n, count[33] / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, sum(w in _TAIL for w in words) / n,
        sum(w[-1] in _TAIL for w in words) / n, n / (1 + stops), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), worst, len(zlib.compress(raw, 1)) / len(raw), -(share * np.log2(share)).sum(), len(pairs) / max(1, n - 1),
    ]


@dataclass
class Trees:
    """Boosted trees as flat arrays: node i of a tree goes to child[i] if x[feature[i]] <= cut[i], else to child[i] + 1; a leaf's child is
    itself, by an infinite cut."""

    base: float = 0.0
    depth: int = 4
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    child: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, child, value in zip(self.feature, self.cut, self.child, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = child[node] + (x[rows, feature[node]] > cut[node])
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0,
    least: float = 3.0
) -> Trees:
    """Newton boosting of the logistic loss from histograms of at most `bins` bins a feature."""
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return Trees(float(np.log(p / (1 - p))), depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = max(len(e) for e in edges) + 1
    p = y.mean()
    trees = Trees(float(np.log(p / (1 - p))), depth)
    raw, columns = np.full(len(y), trees.base), np.arange(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - y, p * (1 - p)
        feature, cut, child, value = [0], [np.inf], [0], [0.0]
        node, level = np.zeros(len(y), np.int64), [0]
        for d in range(depth + 1):
            following = []
            for k in level:
                own = np.flatnonzero(node == k)
                g, h = slope[own], curve[own]
                value[k] = float(-rate * g.sum() / (h.sum() + ridge))
                if d == depth or len(own) < 2:
                    continue
                flat = (binned[own] + columns * width).ravel()
                gs = np.cumsum(np.bincount(flat, np.repeat(g, len(columns)), width * len(columns)).reshape(-1, width), axis=1)
                hs = np.cumsum(np.bincount(flat, np.repeat(h, len(columns)), width * len(columns)).reshape(-1, width), axis=1)
                gt, ht = g.sum(), h.sum()
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[k], cut[k], child[k] = int(f), float(edges[f][b]), len(feature)
                goes = binned[own, f] > b
                node[own] = len(feature) + goes
                for _ in range(2):
                    following.append(len(feature))
                    feature.append(0)
                    cut.append(np.inf)
                    child.append(len(child))
                    value.append(0.0)
            level = following
        raw += np.array(value)[node]
        for kept, made in ((trees.feature, feature), (trees.cut, cut), (trees.child, child), (trees.value, value)):
            kept.append(np.array(made))
    return trees


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([statistics(t) for t in column(batch, "text")], pa.list_(pa.float64()))],
            names=["__id", "label", "x"]
        )


def sample_labels(labels: DataFrame, label: str, id_col: str, per_class: int) -> DataFrame:
    """At most per_class learnable rows (id, label) of each label: those whose ids hash lowest."""
    known = labels.filter(
        F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    ).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).cast("int").alias("label"))
    order = F.xxhash64("__id")
    return known.filter("label = 0").orderBy(order, "__id").limit(per_class).unionByName(
        known.filter("label = 1").orderBy(order, "__id").limit(per_class)
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = PER_CLASS
) -> Trees:
    ship(docs.sparkSession)
    some = F.broadcast(sample_labels(labels, label, id_col, per_class))  # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(some, "__id").select("__id", "label", "text")
    measured = rows.mapInArrow(lean(_measure), f"__id {dict(rows.dtypes)['__id']}, label int, x array<double>")
    found = sorted((r["label"], r["x"]) for r in measured.groupBy("__id", "label").agg(F.min("x").alias("x")).collect())
    x = np.array([x for _, x in found], dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([y for y, _ in found], dtype=np.float64))


def _scores(model, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    if batch.num_rows == 0:
        return np.empty(0)
    return model.value.score(np.array([statistics(t) for t in column(batch, text_col)], dtype=np.float64).reshape(-1, len(STATISTICS)))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (probability of label 1) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_scores(shared, batch, "text"), pa.float64())], names=["id", "score"]
            )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"id {dict(base.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, in one pass."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared, batch, text_col) >= threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
