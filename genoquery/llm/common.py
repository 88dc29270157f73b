"""What the operators share: shipping code to executors, reading tables, and hashing words and word n-grams."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SHINGLE = 5
SIMILARITY = 0.8
_SHIPPED: set[str] = set()


#: Arrow batches of the session's defaults hold 10,000 texts or 64 MB on either side of a Python worker; these bound them for long texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 2_000), "spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, 8 << 20)}


def ship(spark: SparkSession) -> None:
    """Let executors import this package whatever their PYTHONPATH: they fetch it from the driver as a zip. Batch sizes that nobody has
    set are made smaller."""
    for name, (default, size) in BATCH.items():
        if str(spark.conf.get(name, str(default))).rstrip("b") == str(default):
            spark.conf.set(name, str(size))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="genoquery-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, "genoquery.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, as a task that gives its worker's free memory back when it ends: workers live on, and their heaps add up."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """The contract's split: rows whose crc32 of the id's text leaves remainder 0 by 5 are never learnt from. A null id counts as text
    ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEPS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INSIDE = np.ones(256, np.int8)
_INSIDE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0  # ASCII's white space, as str.split has it
#: How the UTF-8 of all other white space begins.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
KEPT_POWERS = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 1 to n, and to 0 to -(n - 1), modulo 2**64. Tables of up to KEPT_POWERS are kept."""
    if not _powers or len(_powers[0]) < n:
        size = min(KEPT_POWERS, 1 << n.bit_length()) if n <= KEPT_POWERS else n
        made = [np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64) for b in (_BASE, _INVERSE)]
        made[1] = np.concatenate((np.ones(1, np.uint64), made[1][:-1]))
        if size > KEPT_POWERS:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word (lower case, split at white space), the same on every machine. Null or empty: none.

    With prefixes, a row for the words, and one for the words' first so many bytes of each size given. A word's hash is a polynomial
    of its bytes, taken from one running sum over the text.
    """
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if len(data) != len(text or "") and any(x in data for x in _WIDE):  # white space beyond ASCII may be in it
        data = " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_INSIDE[raw], prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty((1 + len(prefixes), 0) if prefixes else 0, dtype=np.uint64)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up, out=sums[1:])
    before, back = sums[starts], down[starts]
    whole = mix((sums[ends] - before) * back + (ends - starts).astype(np.uint64) * _BASE)
    if not prefixes:
        return whole
    cut = [mix((sums[np.minimum(starts + k, ends)] - before) * back + np.uint64(k)) for k in prefixes]
    return np.stack([whole, *cut])


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of n words, by position; a text of 1 to n-1 words has one run of all its words."""
    if len(words) == 0:
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        total += words[i : len(words) - size + 1 + i] * _STEPS[i]
    return mix(total)


def column(batch: pa.RecordBatch, name: str) -> Iterator:
    """The values of a column one at a time, so that only one is a Python object at once."""
    values = batch.column(batch.schema.get_field_index(name))
    return (values[i].as_py() for i in range(len(values)))
