"""Token counts by offset-mapped attribution.

A whole document is encoded once. The bytes of its ids give each token's span, which is joined, as an interval, to the sections of
the text. A token that crosses a boundary goes by an explicit rule:

    first   to the section that holds its first character
    last    to the section that holds its last character
    most    to the section that holds most of its bytes; of equal shares to the earliest
    split   to every section in proportion to its bytes

Sections are either the lines of the text (each with its line break), or spans given as a column: an array of structs (start, end)
in characters, ascending and without overlap. Tokens in no given section are counted as section null.

Defined results: a null or empty text, or one without a section, has one row, section 0 from 0 to 0 with no tokens. A text of any length is
encoded whole, and takes memory in proportion to itself. Null ids are kept, repeated rows are counted each. Counts of a document's rows add
up to its tokens under each rule; of equal shares (most) the earliest section counts. An empty table gives no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.llm.common import column, lean, ship, table
from genoquery.llm.packing import encoder

RULES = ("first", "last", "most", "split")


def attribute(ends: np.ndarray, starts_at: np.ndarray, stops_at: np.ndarray, rule: str = "first") -> tuple[np.ndarray, float]:
    """(tokens of each section, tokens of none). ends: each token's end in bytes; sections by their bytes, ascending."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not len(ends):
        return np.zeros(len(starts_at)), 0.0
    begins = np.concatenate(([0], ends[:-1]))
    if rule in ("first", "last"):
        spot = begins if rule == "first" else ends - 1
        at = np.searchsorted(starts_at, spot, side="right") - 1
        inside = (at >= 0) & (spot < stops_at[at])
        return np.bincount(at[inside], minlength=len(starts_at)).astype(float), float((~inside).sum())
    # all overlaps of a token and a section: both lists ascend, so a token's sections are a run
    lo = np.searchsorted(stops_at, begins, side="right")
    hi = np.searchsorted(starts_at, ends, side="left")
    many = np.maximum(hi - lo, 0)
    token = np.repeat(np.arange(len(ends)), many)
    section = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    share = np.minimum(ends[token], stops_at[section]) - np.maximum(begins[token], starts_at[section])
    if rule == "split":
        part = share / np.maximum(1, ends - begins)[token]
        return np.bincount(section, part, len(starts_at)), float(len(ends) - part.sum())
    order = np.lexsort((section, -share, token))
    first = order[np.concatenate(([True], token[order][1:] != token[order][:-1]))] if len(order) else order
    return np.bincount(section[first], minlength=len(starts_at)).astype(float), float(len(ends) - len(first))


def line_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in characters of each line with its line break."""
    spans, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            spans.append((at, end))
        at = end
    return spans


def _count(path: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = encoder(path)
        sizes = np.array([len(p) for p in pieces], np.int64)
        for batch in batches:
            rows, out = [], [[] for _ in range(5)]
            spans_of = column(batch, "spans") if given else iter(lambda: None, 0)
            for i, (text, own) in enumerate(zip(column(batch, "text"), spans_of, strict=False)):
                text = text or ""
                raw = text.encode("utf-8")
                ids = encode(text)
                spans = [(x["start"], x["end"]) for x in own or ()] if given else line_spans(text)
                lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # a character's first byte
                at_byte = np.append(lead, len(raw))
                edges = np.array(spans, np.int64).reshape(-1, 2).clip(0, len(text))
                counts, rest = attribute(
                    np.cumsum(sizes[ids]), at_byte[edges[:, 0]], at_byte[edges[:, 1]], rule
                ) if len(edges) else (np.zeros(0), float(len(ids)))
                found = [(k, a, b, n, len(ids)) for k, ((a, b), n) in enumerate(zip(edges.tolist(), counts.tolist(), strict=True))]
                if rest > 1e-9:
                    found.append((None, None, None, rest, len(ids)))
                for row in found or [(0, 0, 0, 0.0, 0)]:
                    rows.append(i)
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(out, types, strict=True))],
                names=["id", "section", "start", "end", "tokens", "doc_tokens"]
            )

    return run


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "first",
    tokenizer: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """One row per document and section: id, section, start, end (characters), tokens, doc_tokens."""
    ship(docs.sparkSession)
    spans = [F.col(spans_col).alias("spans")] if spans_col else []
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *spans)
    schema = f"id {dict(base.dtypes)['id']}, section int, start int, end int, tokens double, doc_tokens bigint"
    return base.mapInArrow(lean(_count(tokenizer, rule, bool(spans_col))), schema).withColumnRenamed("id", id_col)


def op4_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    counted = token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("tokens", F.col("tokens").cast("bigint"))
