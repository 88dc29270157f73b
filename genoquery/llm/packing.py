"""Packing by order-preserving dynamic programming.

Documents stay in the order of their partition. Their ids form one line of tokens, cut into sequences of at most `window`
tokens. A cut may stand at a document's end (free), at a sentence's end, or, in a run of tokens without one, at every STRIDE-th
token. f(b), the least cost of cutting the line up to b, is

    f(b) = penalty(b) + min over a in [b - window, b) of f(a) + padding(b - a)

with padding(n) = window - n, and 0 where n is a power of two. As window - (b - a) = (window - b) + a, the first kind of
transition needs the minimum of f(a) + a over a sliding range: a monotone queue gives it in constant time. The powers of two are
looked up one by one.

Partitions are packed on their own (one sequence each may be padded more), in one pass and without a shuffle: a lost executor's
partition is packed again from its rows alone, with the same sequences. The line is cut in stretches of STRETCH tokens, each
continuing from the last settled cut, so memory is bounded whatever the partition's size; a document of any length only ever has
its own ids in memory.

Defined results: a null or empty text is one token (id 0). A null id, repeated rows and extra columns, whatever their names, don't matter:
each
row is a document of its own, and its pieces carry its id. Of equally cheap cuts the one whose sequence began earliest is kept, except
that a
power of two is taken only if it is cheaper. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.llm.common import column, lean, ship, table

WINDOW = 1024
SENTENCE_CUT = 6
FREE_CUT = 48
STRIDE = 32
STRETCH = 1 << 18
END = "<|endoftext|>"
_ENCODERS: dict[str, tuple] = {}


def encoder(path: str):
    """(encode to an array of ids, bytes of each id) of a byte-level BPE. It's read as ranks, which are the vocabulary's ids; the results
    equal the tokenizers library's with add_special_tokens=False, five times as fast."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        lines = map(bytes.split, open(public_tokenizers.path(path), "rb"))
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        special = {END: len(ranks)}
        made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        pieces = [b""] * (len(ranks) + 1)
        for piece, i in [*ranks.items(), (END.encode(), len(ranks))]:
            pieces[i] = piece
        _ENCODERS[path] = (lambda text: made.encode_to_numpy(text, allowed_special="all"), pieces)
    return _ENCODERS[path]


def sentence_ends(pieces: list[bytes]) -> np.ndarray:
    """For each id, whether a sentence may end with it: its last byte is a stop or a line break."""
    return np.array([p[-1:] in (b".", b"!", b"?", b"\n") for p in pieces])


def boundaries(ids: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of these ids may be cut (as counts of ids before the cut) and what a cut there costs; the last is its end."""
    inner = np.flatnonzero(ends[ids[:-1]]) + 1 if len(ids) > 1 else np.empty(0, dtype=np.int64)
    at = np.concatenate((inner, [len(ids)]))
    before = np.concatenate(([0], at[:-1]))
    many = (at - before - 1) // stride
    extra = np.repeat(before, many) + stride * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1)
    cost = np.concatenate((np.full(len(inner), SENTENCE_CUT), [0], np.full(len(extra), FREE_CUT)))
    where = np.concatenate((at, extra))
    order = np.argsort(where, kind="stable")
    return where[order], cost[order]


def cuts(where: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest cuts of the line from 0 to where[-1], as indexes into where; neighbours in `where` are at most `window` apart."""
    powers = [1 << i for i in range(window.bit_length()) if 1 << i < window]
    spot = {0: -1}
    best, back = [], []
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (f(a) + a, a, index)
    for i, b in enumerate(where):
        while queue[0][1] < b - window:
            queue.popleft()
        low, _, via = queue[0]
        low += window - b
        for p in powers:
            a = spot.get(b - p)
            if a is not None:
                other = best[a] if a >= 0 else 0
                if other < low:
                    low, via = other, a
        low += cost[i]
        best.append(low)
        back.append(via)
        spot[b] = i
        key = low + b
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, b, i))
    found, i = [], len(where) - 1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


class _Line:
    """The documents not yet packed: their ids, their places on the line, and where it may be cut."""

    def __init__(self, first: int, window: int):
        self.docs: deque = deque()  # [document's id, ids, ids packed already]
        self.where: list[int] = []
        self.cost: list[int] = []
        self.length, self.sequence, self.window = 0, first, window
        self.out: list[list] = [[] for _ in range(7)]

    def add(self, doc, ids: np.ndarray, ends: np.ndarray) -> None:
        where, cost = boundaries(ids, ends)
        self.where += (where + self.length).tolist()
        self.cost += cost.tolist()
        self.docs.append([doc, ids, 0])
        self.length += len(ids)

    def pack(self, last: bool) -> None:
        """Write the sequences of all that's held; unless it's the end, the last quarter is kept for the next stretch."""
        if not self.where:
            return
        chosen = [self.where[i] for i in cuts(self.where, self.cost, self.window)]
        if not last:
            chosen = [c for c in chosen if c <= self.length - self.length // 4] or chosen[:1]
        begin = 0
        for end in chosen:
            self._write(end - begin)
            begin = end
        kept = np.searchsorted(self.where, begin, side="right")
        self.where, self.cost = [w - begin for w in self.where[kept:]], self.cost[kept:]
        self.length -= begin

    def _write(self, size: int) -> None:
        offset = 0
        while offset < size:
            doc, ids, at = self.docs[0]
            n = min(len(ids) - at, size - offset)
            row = (doc, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), len(ids), self.sequence, offset)
            for x, v in zip(self.out, row, strict=True):
                x.append(v)
            offset += n
            if at + n == len(ids):
                self.docs.popleft()
            else:
                self.docs[0][2] = at + n
        self.sequence += 1

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        out, self.out = self.out, [[] for _ in range(7)]
        types = [kind] + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, types, strict=True)],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        )


def _pack(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = encoder(path)
        ends = sentence_ends(pieces)
        line, kind = _Line(TaskContext.get().partitionId() << 36, window), None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids = batch.column(0)
            for i, text in enumerate(column(batch, "text")):
                line.add(ids[i].as_py(), np.append(encode(text or ""), np.uint32(0)).astype(np.uint32), ends)
                if line.length >= STRETCH:
                    line.pack(False)
            if len(line.out[0]):
                yield line.take(kind)
        line.pack(True)
        if kind is not None:
            yield line.take(kind)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", window: int = WINDOW
) -> DataFrame:
    """One row per piece: id, start and length in its document's ids, ids_crc32, doc_tokens, sequence_id, offset. `tokenizer` names a
    ranks file of public_tokenizers."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(base.dtypes)['id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return base.mapInArrow(lean(_pack(tokenizer, window)), schema).withColumnRenamed("id", id_col)


def op8_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
