"""N-gram Jaccard join by MinHash banding.

1. One Python pass reads each text and leaves a digest of its set of word 5-grams and its band hashes.
2. Texts with equal sets are one node from here on (aggregated before any join, so a group of copies costs one row).
3. Band hashes are shuffled; a band that two nodes share makes them candidates. Nodes of shared bands are dealt into blocks
   of bounded weight (larger ones where a class would have more than FEW_PARTS, so fewer blocks meet); a pair of blocks that share a
   band is one task's work, so no pair of nodes ever is a row.
4. Each pair of blocks gets its nodes' full n-gram sets, verifies every two nodes that share a band, and returns for each node
   the copies it links to and one parent in the verified graph. Components of those parents are the classes.

Counting the links of N different texts that are all near copies of each other compares N * N / 2 sets by definition; that work is done by
matrix products over the n-grams that sets of a pair of blocks share, and is spread over about (N / BLOCK_NODES)^2 / 2 tasks.

Defined results: a null or empty text (no words) has no n-grams, links to nothing and is a class of its own. A text of 1 to 4
words has one n-gram of all its words; a text of any length is read whole. Repeated rows are copies: each row is returned, and a copy
counts as a link. Null ids are
kept; a class's id is the smallest id in it (null if it has none). Ties don't arise: all counts are exact. An empty table gives no rows;
other columns, whatever their names, are left out (`near_duplicates`) or kept as they are (`keep_one`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.checkpoints import checkpoint, sweep
from genoquery.llm.common import SHINGLE, SIMILARITY, column, lean, shingles, ship, table, unused, word_hashes
from genoquery.operators.components import connected_components

TARGET_RECALL = 0.9995
MAX_HASHES = 160
BLOCK_NODES = 128
BLOCK_GRAMS = 200_000
FEW_PARTS, LARGE_NODES, LARGE_GRAMS = 64, 1024, 1_000_000


def choose_bands(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose band count reaches the recall at the similarity within `most` hashes. Raises where none
    does."""
    best = None
    for rows in range(1, most + 1):
        hit = similarity**rows
        if hit >= 1:
            return 1, rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"a recall of {recall} at a similarity of {similarity} takes more than {most} hashes")
    return best


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    return rng.integers(1, 2**32, count, dtype=np.uint32), rng.integers(1, 2**32, count, dtype=np.uint32) | np.uint32(1)


def min_hashes(grams: np.ndarray, count: int) -> np.ndarray:
    """The minimum of each of `count` hash functions over the n-grams."""
    xors, odds = _permutations(count)
    low, best = (grams >> np.uint64(32)).astype(np.uint32), np.full(count, 2**32 - 1, dtype=np.uint32)
    for a in range(0, len(low), 1024):
        np.minimum(best, ((low[a : a + 1024] ^ xors[:, None]) * odds[:, None]).min(axis=1), out=best)
    return best


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> list[int]:
    """A signed 64-bit hash of each band, which also holds the band's number."""
    return [
        int.from_bytes(
            hashlib.blake2b(b.to_bytes(4, "little") + signature[b * rows : (b + 1) * rows].tobytes(), digest_size=8).digest(), "little",
            signed=True
        ) for b in range(bands)
    ]


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"digest": [], "n_grams": [], "bands": []}
            for text in column(batch, "text"):
                grams = np.unique(shingles(word_hashes(text), n))
                if len(grams):
                    out["digest"].append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    out["bands"].append(band_hashes(min_hashes(grams, bands * rows), bands, rows))
                else:
                    out["digest"].append(None)
                    out["bands"].append(None)
                out["n_grams"].append(len(grams))
            kept = [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept, pa.array(out["digest"], pa.binary()), pa.array(out["n_grams"], pa.int32()),
                    pa.array(out["bands"], pa.list_(pa.int64()))
                ],
                names=["id", "text_key", "digest", "n_grams", "bands"]
            )

    return run


FILTER_BITS = 1 << 26


def _places(key: str, carrier: int) -> tuple[int, int, int]:
    return int(key[:12], 16) % FILTER_BITS, int(key[12:24], 16) % FILTER_BITS, carrier % FILTER_BITS


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits (8 MB, whatever the input) of (text_key, carrier). It only saves work: what it lets through is
    joined exactly, and a full one lets all through."""
    places = F.array(
        *(F.pmod(F.conv(F.substring("text_key", a, 12), 16, 10).cast("bigint"), F.lit(FILTER_BITS)) for a in (1, 13)),
        F.pmod("carrier", F.lit(FILTER_BITS))
    )
    words = keys.select(F.explode(places).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")
    ).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _sets(n: int, shared):
    """The n-gram sets of the texts that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            kept = pa.array(
                [i for i, (k, c) in enumerate(keys) if all(int(bits[p >> 6]) >> (p & 63) & 1 for p in _places(k, c))], pa.int64()
            )
            own = batch.take(kept)
            grams = pa.array([np.unique(shingles(word_hashes(t), n)).tobytes() for t in column(own, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), grams], names=["text_key", "carrier", "grams"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[i]] and sets[right[i]]."""
    if len(left) <= 256:
        return np.array(
            [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64
        )
    rows, i = np.unique(left, return_inverse=True)
    columns, j = np.unique(right, return_inverse=True)
    used = np.union1d(rows, columns)
    who = np.repeat(used, [len(sets[u]) for u in used])
    _, what, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = times[what] > 1
    who, what = who[shared], np.unique(what[shared], return_inverse=True)[1]
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    both = np.zeros((len(rows), len(columns)), dtype=np.float32)
    width = 4096
    for a in range(0, int(what[-1]) + 1 if len(what) else 0, width):
        lo, hi = np.searchsorted(what, [a, a + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[who[lo:hi], what[lo:hi] - a] = 1
        both += has[rows] @ has[columns].T
    return both[i, j].astype(np.int64)


def _parents(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    found = np.arange(n)
    while True:
        low, new = np.minimum(found[left], found[right]), found.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, found):
            return found
        found = new


def verify(block: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links among the nodes of one pair of blocks: each node's number of linked rows in other nodes, and a parent in the linked graph.

    Two nodes of one block meet in the pair of that block with itself, and in no other.
    """
    block = block.sort_values(["side", "digest"], ignore_index=True)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in block["grams"]]
    side, sizes = block["side"].to_numpy(), np.array([len(s) for s in sets])
    own = int((side == 0).sum())
    alone = own == len(sets)
    by_band: dict[int, list[int]] = {}
    for i, bands in enumerate(block["live"]):
        for b in bands:
            by_band.setdefault(b, []).append(i)
    # nodes of the first block by nodes of the second (or of itself) that share a band
    met, base = np.zeros((own, len(sets) if alone else len(sets) - own), bool), 0 if alone else own
    for members in by_band.values():
        if len(members) > 1:
            m = np.array(members)
            met[np.ix_(m[m < own], m[m >= base] - base)] = True
    if alone:
        met = np.triu(met, 1)
    left, right = np.nonzero(met)
    right = right + base
    fits = np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right]) - 1e-9
    left, right = left[fits], right[fits]
    inter = _overlaps(sets, left, right) if len(left) else np.empty(0, dtype=np.int64)
    ok = inter / np.maximum(1, sizes[left] + sizes[right] - inter) >= similarity
    left, right = left[ok], right[ok]
    mult, links = block["mult"].to_numpy(), np.zeros(len(sets), dtype=np.int64)
    np.add.at(links, left, mult[right])
    np.add.at(links, right, mult[left])
    some, parents = np.flatnonzero(links), _parents(len(sets), left, right)
    digests = block["digest"].to_numpy()
    return pd.DataFrame({"digest": digests[some], "links": links[some], "parent": digests[parents[some]]})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY,
    recall: float = TARGET_RECALL
) -> DataFrame:
    """One row per row of docs: id, class_id (smallest id of its class), n_links (other rows whose n-gram sets' Jaccard similarity with
    this row's is at least `similarity`), n_grams, text_key (md5 of the text)."""
    spark = docs.sparkSession
    ship(spark)
    bands, rows = choose_bands(similarity, recall)
    keyed = docs.select(
        F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_key"),
        F.col(text_col).alias("text")
    )
    carrier = F.xxhash64("id")  # tells copies of a text apart, so that they don't meet in one task
    id_type = dict(keyed.dtypes)["id"]
    signed = checkpoint(
        keyed.mapInArrow(lean(_sign(n, bands, rows)), f"id {id_type}, text_key string, digest binary, n_grams int, bands array<bigint>"),
        wide=True
    )

    nodes = signed.filter("digest is not null").groupBy("digest").agg(
        F.count("*").alias("mult"), F.min("id").alias("low"),
        F.min(F.struct("text_key", carrier.alias("carrier"), "n_grams", "bands")).alias("x")
    )
    nodes = nodes.select("digest", "mult", "low", "x.text_key", "x.carrier", "x.n_grams", "x.bands")
    in_band = nodes.select("digest", F.explode("bands").alias("band"))
    # here and below: a side that is written first, not summed up in the join's own stage, lets adaptive execution split a hot key's rows
    shared = checkpoint(
        in_band.groupBy("band").agg(F.min("digest").alias("first"), F.count("*").alias("k")).filter("k > 1").select("band", "first")
    )
    sweep(spark)
    live = in_band.join(shared, "band").groupBy("digest").agg(F.min("first").alias("root"), F.collect_set("band").alias("live")).join(
        nodes.select("digest", "n_grams", "mult", "text_key", "carrier"), "digest"
    )
    live = checkpoint(live)
    parts = lambda nodes, grams: F.greatest(F.lit(1), F.ceil(F.count("*") / nodes), F.ceil(F.sum("n_grams") / grams)).cast("int")
    few, large = parts(BLOCK_NODES, BLOCK_GRAMS), F.greatest(F.lit(FEW_PARTS), parts(LARGE_NODES, LARGE_GRAMS))
    weights = checkpoint(live.groupBy("root").agg(F.least(few, large).alias("parts")))
    dealt = live.join(weights, "root").withColumn("block", F.xxhash64("root", F.pmod(F.xxhash64("digest"), F.col("parts"))))
    dealt = checkpoint(dealt.select("digest", "mult", "text_key", "carrier", "live", "block"))

    sweep(spark)
    band_blocks = dealt.select("block", F.explode("live").alias("band")).groupBy("band", "block").agg(F.count("*").alias("k"))
    here = band_blocks.filter("k > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    across = band_blocks.select("band", F.col("block").alias("a")).join(
        band_blocks.select("band", F.col("block").alias("b")), "band"
    ).filter("a < b").select("a", "b")
    work = here.unionByName(across).distinct()
    seats = work.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        work.filter("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side"))
    )

    shared = spark.sparkContext.broadcast(bloom_filter(dealt.select("text_key", "carrier")))
    sets = keyed.select("text_key", carrier.alias("carrier"), "text").mapInArrow(
        lean(_sets(n, shared)), "text_key string, carrier bigint, grams binary"
    )
    # of rows that repeat a text under one id, one set is enough
    full = dealt.join(sets, ["text_key", "carrier"]).groupBy("block", "digest").agg(
        F.first("mult").alias("mult"), F.first("live").alias("live"), F.first("grams").alias("grams")
    )
    found = seats.join(full, "block").groupBy("a", "b").applyInPandas(
        lambda pdf: verify(pdf, similarity), "digest binary, links bigint, parent binary"
    )
    found = checkpoint(found)

    sweep(spark)
    classes = connected_components(found.select(F.col("digest").alias("src"), F.col("parent").alias("dst")))
    degree = found.groupBy("digest").agg(F.sum("links").alias("links"))
    linked = nodes.select("digest", "mult", "low").join(degree, "digest", "left").join(
        classes.select(F.col("node").alias("digest"), "component"), "digest", "left"
    )
    linked = checkpoint(
        linked.select(
            "digest", "low", F.coalesce("component", "digest").alias("component"),
            (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        )
    )
    lowest = checkpoint(linked.groupBy("component").agg(F.min("low").alias("class_id")))
    by_digest = linked.join(lowest, "component").select("digest", "class_id", "n_links")
    return signed.select("id", "text_key", "digest", "n_grams").join(by_digest, "digest", "left").select(
        F.col("id").alias(id_col), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_grams", "text_key", F.col("digest").isNull().alias("no_words")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that stay: of each class the row with the smallest id. Rows without words or without an id stay. Of rows that
    repeat an id the one whose text's md5 is smallest stays, once."""
    found = near_duplicates(docs, id_col, text_col, **params).filter(~F.col("no_words") & F.col(id_col).isNotNull())
    key, text_key = unused(docs, "id"), unused(docs, "text_key")
    found = checkpoint(
        found.select(F.col(id_col).alias(key), F.col("text_key").alias(text_key), (F.col("class_id") != F.col(id_col)).alias("gone"))
    )
    twice = found.filter("not gone").groupBy(key).agg(F.count("*").alias("n"), F.min(text_key).alias("first")).filter("n > 1")
    gone = found.filter("gone").select(key, text_key).unionByName(
        found.join(twice, key).filter(~F.col("gone") & (F.col(text_key) != F.col("first"))).select(key, text_key)
    ).distinct()
    keyed = docs.withColumn(key, F.col(id_col)).withColumn(text_key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    left = keyed.join(gone, [key, text_key], "left_anti")
    if not twice.isEmpty():
        left = checkpoint(left, wide=True)
        again = twice.select(key)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key, text_key]))
    return left.select(*docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_grams")
