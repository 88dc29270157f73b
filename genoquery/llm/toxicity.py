"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and
word beginnings (inflected forms share those); a document's is the noisy-or of
its sentences' scores, 1 - prod(1 - p), and that is what the documents' labels train. The sentence scores then locate the
offending sentences.

Training rows are at most `per_class` rows of each label (lowest hash of the id, never held-out ones), and of those the first in that
order whose hashed words take `label_bytes` together; the driver gets these hashed words only, 2 * label_bytes at most (and one text
more), of documents that repeat a sampled id those of one (the least). The optimiser is AdaGrad on batches in a fixed order, so a fit is
repeatable.

Defined results: a null or empty text has no sentence and scores 0. Null labels are skipped; of labels that differ for one id the
smaller counts. Without both labels every score is 0. Ids may be null or repeat: each row is scored from its text alone, whatever its
length. Of equally bad sentences all are located. An empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.llm.common import column, held_out, lean, ship, table, word_hashes
from genoquery.llm.quality import sample_labels

PER_CLASS = 4000
LABEL_BYTES = 32 << 20
THRESHOLD = 0.5
BITS = 19
PREFIXES = (4, 5, 6)
LEAST_ROWS = 3
_STOP = re.compile(r"[.!?\n]+")
_OTHER = re.compile(r"[^\w\x01]+")
_MARK = word_hashes("\x01")[0]
_SENTENCE = re.compile(r"[^.!?\n]+")


def _words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words and, in further rows, their beginnings; number of each word's sentence). Sentences without words have no number."""
    hashes = word_hashes(_OTHER.sub(" ", _STOP.sub(" \x01 ", (text or "").replace("\x01", " ").lower())), PREFIXES)
    ends = hashes[0] == _MARK
    inside = ~ends
    where = np.cumsum(ends)[inside]
    number = np.cumsum(np.diff(where, prepend=where[:1]) > 0)
    return (hashes[:, inside] >> np.uint64(64 - BITS)).astype(np.int64), number


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed words and beginnings, start of each sentence in them): a word counts once in a sentence."""
    codes, number = _words(text)
    keys = np.unique((number << BITS) | codes)
    starts = np.flatnonzero(np.diff(keys >> BITS, prepend=-1)) if len(keys) else np.empty(0, np.int64)
    return (keys & ((1 << BITS) - 1)).astype(np.int32), starts


@dataclass
class Words:
    """Weights of hashed words; `level` is a sentence's logit without any."""

    weights: np.ndarray
    level: float

    def sentence_scores(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0)
        z = self.level + np.add.reduceat(self.weights[words].astype(np.float64), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def by_sentence(self, text: str | None) -> np.ndarray:
        """The scores of a text's sentences; only words that weigh anything are made distinct."""
        codes, number = _words(text)
        if not len(number):
            return np.empty(0)
        row, word = np.nonzero(self.weights[codes])
        keys = np.unique((number[word] << BITS) | codes[row, word])
        z = self.level + np.bincount(keys >> BITS, self.weights[keys & ((1 << BITS) - 1)], int(number[-1]) + 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        p = self.by_sentence(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0

    def located(self, text: str | None, threshold: float = THRESHOLD) -> list[dict]:
        """Spans of characters and scores of the sentences that score at least the threshold."""
        found = []
        for m in _SENTENCE.finditer(text or ""):
            own = self.by_sentence(m[0])
            if len(own) and own.max() >= threshold:
                found.append({"start": m.start(), "end": m.end(), "score": float(own.max())})
        return found


def fit(
    bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12, batch: int = 32, rate: float = 1.0, level: float = -9.0,
    shrink: float = 1e-4, least: int = LEAST_ROWS, floor: float | None = 0.0
) -> Words:
    """Weights that make the noisy-or of each bag fit its label."""
    model = Words(np.zeros(1 << BITS, np.float32), level)
    if len(y) == 0 or y.min() == y.max():
        return Words(model.weights, -30.0)
    seen = np.zeros(1 << BITS, np.int32)
    for words, _ in bags:
        seen[np.unique(words)] += 1
    learnt = seen >= least
    power = np.full(1 << BITS, 1e-2, np.float32)
    rng = np.random.Generator(np.random.PCG64(31))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = [i for i in order[a : a + batch] if len(bags[i][1])]
            if not rows:
                continue
            words = np.concatenate([bags[i][0] for i in rows])
            offsets = np.cumsum([0, *(len(bags[i][0]) for i in rows)])[:-1]
            starts = np.concatenate([bags[i][1] + o for i, o in zip(rows, offsets, strict=True)])
            counts = np.array([len(bags[i][1]) for i in rows])
            p = model.sentence_scores(words, starts)
            none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), np.cumsum([0, *counts[:-1]]))
            some = np.maximum(-np.expm1(none), 1e-9)
            pull = np.where(y[rows] == 1, -np.exp(none) / some, 1.0) * balance[rows]
            by_sentence = np.repeat(pull, counts) * p
            by_word = np.repeat(by_sentence, np.diff(np.append(starts, len(words))))
            used, place = np.unique(words, return_inverse=True)
            slope = (np.bincount(place, by_word) + shrink * model.weights[used]) * learnt[used]
            power[used] += slope**2
            model.weights[used] -= rate * slope / np.sqrt(power[used])
            if floor is not None:
                model.weights[used] = np.maximum(model.weights[used], floor)
    return model


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [sentences(t) for t in column(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([w.tobytes() for w, _ in bags], pa.binary()),
                pa.array([s.astype(np.int32).tobytes() for _, s in bags], pa.binary())
            ],
            names=["__id", "label", "words", "starts"]
        )


def sample_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, per_class: int, label_bytes: int) -> DataFrame:
    """(label, words, starts) of the training rows. Only the few columns of at most 2 * per_class rows meet in a window."""
    ship(docs.sparkSession)
    some = F.broadcast(sample_labels(labels, label, id_col, per_class))  # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(some, "__id").select("__id", "label", "text")
    hashed = rows.mapInArrow(lean(_hash), f"__id {dict(rows.dtypes)['__id']}, label int, words binary, starts binary")
    least = checkpoint(
        hashed.groupBy("__id", "label").agg(
            F.min(F.struct("words", "starts")).alias("bag")
        ).select("__id", "label", "bag.words", "bag.starts")
    )
    before = Window.partitionBy("label").orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, -1)
    held = least.select(
        "__id", "label", (F.length("words") + F.length("starts")).cast("bigint").alias("bytes")
    ).withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    kept = held.filter(F.col("before") < label_bytes).select("__id")
    return least.join(F.broadcast(kept), "__id").select("label", "words", "starts")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = PER_CLASS,
    label_bytes: int = LABEL_BYTES
) -> Words:
    rows = sample_bags(docs, labels, id_col, text_col, label, per_class, label_bytes).collect()  # bounded by label_bytes
    found = sorted((r["label"], bytes(r["words"]), bytes(r["starts"])) for r in rows)
    bags = [(np.frombuffer(w, np.int32), np.frombuffer(s, np.int32)) for _, w, s in found]
    return fit(bags, np.array([y for y, _, _ in found], dtype=np.float64))


def score(docs: DataFrame, model: Words, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (probability of label 1) and, for texts at or above the threshold, the offending sentences (start, end, score)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in column(batch, "text"):
                scores.append(shared.value.score(text))
                spans.append(shared.value.located(text, threshold) if scores[-1] >= threshold else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["id", "score", "sentences"]
            )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(base.dtypes)['id']}, score double, sentences array<struct<start:int,end:int,score:double>>"
    return base.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def op5_toxic_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, and how many of its sentences offend."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences")
    )
