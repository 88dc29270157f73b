"""Similar pairs of accessions: an exact block join on bit masks, and a chunk-hash prefilter in front of it.

Counts over markers known in both: n02 (opposite homozygotes), n00_22 (equal homozygotes), n01_12 (one step apart), n11 (both
heterozygous). agmr = (n02 + n01_12) / all four, hgmr = n02 / (n02 + n00_22). Undefined ratios are null, and pairs without an
agmr are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from genoquery.checkpoints import checkpoint, sweep
from genoquery.functions.hashing import key
from genoquery.functions.masks import NAMES, bits, pack
from genoquery.functions.ratios import ratio

BLOCK, BLOCKS, PART = 1024, 16, 1024
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 32 << 20
PAIR = "q_id string, q_md bigint, m_id string, m_md bigint, n02 bigint, n00_22 bigint, n01_12 bigint, n11 bigint"
COUNTS = ("n02", "n00_22", "n01_12", "n11")


def pair_counts(get):
    """The four counts as bit conditions, by name; get('a', '0') is a's word for dosage 0."""
    a0, a1, a2, b0, b1, b2 = (get(s, d) for s in "ab" for d in "012")
    return {
        "n02": (a0.bitwiseAND(b2)).bitwiseOR(a2.bitwiseAND(b0)), "n00_22": (a0.bitwiseAND(b0)).bitwiseOR(a2.bitwiseAND(b2)),
        "n01_12": a1.bitwiseAND(b0.bitwiseOR(b2)).bitwiseOR(b1.bitwiseAND(a0.bitwiseOR(a2))), "n11": a1.bitwiseAND(b1)
    }


def with_counts(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """pairs with struct columns `left` and `right` that hold m0, m1, m2, plus the four counts; all in the JVM."""
    side = {"a": left, "b": right}
    made = [bits(F.col(f"{left}.m0"), lambda get, n=n: pair_counts(lambda s, d: get(f"{side[s]}.m{d}"))[n]).alias(n) for n in COUNTS]
    return pairs.select("*", *made)


def with_ratios(pairs: DataFrame) -> DataFrame:
    n02, same, step, het = (F.col(c) for c in COUNTS)
    return pairs.withColumn("agmr", ratio(n02 + step, n02 + same + step + het)).withColumn("hgmr", ratio(n02, n02 + same))


def _kernel(keep):
    """Every two accessions of a pair of blocks, in numpy; only pairs that `keep` wants become rows."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        one = cell["side"].max() == 0
        left, right = cell[cell["side"] == 0], cell if one else cell[cell["side"] == 1]
        a, b = ([np.array(s[n].tolist(), dtype=np.int64).view(np.uint64) for n in NAMES] for s in (left, right))
        found = {c: np.zeros((len(left), len(right)), np.int32) for c in COUNTS}
        for w in range(a[0].shape[1] if len(left) and len(right) else 0):
            (a0, a1, a2), (b0, b1, b2) = [x[:, w][:, None] for x in a], [x[:, w][None, :] for x in b]
            found["n02"] += np.bitwise_count((a0 & b2) | (a2 & b0))
            found["n00_22"] += np.bitwise_count((a0 & b0) | (a2 & b2))
            found["n01_12"] += np.bitwise_count((a1 & (b0 | b2)) | (b1 & (a0 | a2)))
            found["n11"] += np.bitwise_count(a1 & b1)
        wanted = keep(found)
        x_id, y_id = left["acc_id"].to_numpy(), right["acc_id"].to_numpy()
        x_ref, y_ref = left["is_ref"].to_numpy(bool), right["is_ref"].to_numpy(bool)
        if one:
            wanted &= x_id[:, None] > y_id[None, :]
        wanted &= ~(x_ref[:, None] & y_ref[None, :])
        i, j = np.nonzero(wanted)
        # the query is never a reference; of two new ones it's the one with the larger id
        as_is = np.where(x_ref[i] != y_ref[j], ~x_ref[i], x_id[i] > y_id[j])
        sides = {"id": (x_id[i], y_id[j]), "md": (left["n_missing"].to_numpy()[i], right["n_missing"].to_numpy()[j])}
        out = {f"{n}_{k}": np.where(as_is, v[t], v[1 - t]) for t, n in enumerate("qm") for k, v in sides.items()}
        return pd.DataFrame(out | {c: found[c][i, j].astype(np.int64) for c in COUNTS})

    return run


def grid(wide: DataFrame, block: int = BLOCK, grow: bool = False) -> DataFrame:
    """Accessions dealt to a triangle of block pairs (bi <= bj): no task holds more than two blocks, and no pair is ever a row before it's
    wanted.

    An accession is sent once for each block. With `grow`, for tasks that compare parts of a block at a time, BLOCKS blocks are enough up to
    BLOCK_ROWS accessions and BLOCK_BYTES of masks or patterns a block: what is sent grows with the table then, not with its square."""
    words = sum((F.size(c) for c, t in wide.dtypes if t == "array<bigint>"), F.lit(0))
    n, most = wide.agg(F.count("*"), F.coalesce(F.max(words), F.lit(0))).first()
    blocks = max(1, -(-n // block))
    if grow:
        blocks = min(blocks, max(BLOCKS, -(-n // BLOCK_ROWS), -(-n * most * 8 // BLOCK_BYTES)))
    own = wide.withColumn("b", F.pmod(F.xxhash64("acc_id"), F.lit(blocks)).cast("int"))
    cells = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)),
            lambda o: F.struct(
                F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj"), F.when(F.col("b") <= o, 0).otherwise(1).alias("side")
            )
        )
    )
    return own.withColumn("c", cells).select(*wide.columns, "c.bi", "c.bj", "c.side")


def _wide(genotypes: DataFrame) -> DataFrame:
    if "is_ref" not in genotypes.columns:
        genotypes = genotypes.withColumn("is_ref", F.lit(False))
    return checkpoint(pack(genotypes, ("is_ref",)))


def _near(max_distance: float) -> Callable:
    def keep(n):
        total = n["n02"] + n["n00_22"] + n["n01_12"] + n["n11"]
        return (total > 0) & ((n["n02"] + n["n01_12"]) / np.maximum(1, total) <= max_distance)

    return keep


def similar_pairs(genotypes: DataFrame, max_distance: float = 0.2) -> DataFrame:
    """Every pair with agmr <= max_distance, exactly. A row's query (q) is new; its match (m) is new with a smaller id, or a
    reference (is_ref)."""
    return with_ratios(grid(_wide(genotypes)).groupBy("bi", "bj").applyInPandas(_kernel(_near(max_distance)), PAIR))


def _counting(cell: pd.DataFrame) -> pd.DataFrame:
    """How often each (agmr's numerator, denominator) occurs in a pair of blocks."""
    one = cell["side"].max() == 0
    left, right = cell[cell["side"] == 0], cell if one else cell[cell["side"] == 1]
    parts = [
        _counting_part(left.iloc[i : i + PART], right.iloc[j : j + PART], one) for i in range(0, len(left), PART)
        for j in range(0, len(right), PART)
    ]
    if not parts:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("num", "den", "n")})
    return pd.concat(parts).groupby(["num", "den"], as_index=False)["n"].sum()


def _counting_part(left: pd.DataFrame, right: pd.DataFrame, one: bool) -> pd.DataFrame:
    a, b = ([np.array(s[n].tolist(), dtype=np.int64).view(np.uint64) for n in NAMES] for s in (left, right))
    apart, known = (np.zeros((len(left), len(right)), np.int32) for _ in range(2))
    for w in range(a[0].shape[1] if len(left) and len(right) else 0):
        (a0, a1, a2), (b0, b1, b2) = [x[:, w][:, None] for x in a], [x[:, w][None, :] for x in b]
        both = (a0 | a1 | a2) & (b0 | b1 | b2)
        known += np.bitwise_count(both)
        apart += np.bitwise_count(both & ~((a0 & b0) | (a1 & b1) | (a2 & b2)))
    wanted = known > 0
    if one:
        wanted &= left["acc_id"].to_numpy()[:, None] > right["acc_id"].to_numpy()[None, :]
    wanted &= ~(left["is_ref"].to_numpy(bool)[:, None] & right["is_ref"].to_numpy(bool)[None, :])
    keys, times = np.unique(apart[wanted].astype(np.int64) << 32 | known[wanted], return_counts=True)
    return pd.DataFrame({"num": keys >> 32, "den": keys & 0xFFFFFFFF, "n": times})


def distance_counts(genotypes: DataFrame) -> DataFrame:
    """All pairs' distances, as counts: x (agmr) and n (pairs that have it). Pairs never become rows: a task gives the fractions of
    its two blocks."""
    found = grid(_wide(genotypes), grow=True).groupBy("bi", "bj").applyInPandas(_counting, "num bigint, den bigint, n bigint")
    return found.groupBy(ratio("num", "den").alias("x")).agg(F.sum("n").alias("n"))


def related_pairs(genotypes: DataFrame, max_hgmr: float) -> DataFrame:
    """H1: every pair with hgmr <= max_hgmr, exactly, by the same block join."""

    def keep(n):
        hom = n["n02"] + n["n00_22"]
        return (hom > 0) & (n["n02"] / np.maximum(1, hom) <= max_hgmr)

    return with_ratios(grid(_wide(genotypes)).groupBy("bi", "bj").applyInPandas(_kernel(keep), PAIR))


def chunk_patterns(genotypes: DataFrame, size: int = 7, passes: int = 1, seed: int = 1) -> DataFrame:
    """acc_id, chunk, pattern (base 3 number of the chunk's dosages; null if one is missing). Markers are put in an order by hash,
    once for each pass; left-over markers are not used."""
    markers = genotypes.select("marker", "marker_id").distinct()
    found = None
    for p in range(passes):
        place = F.row_number().over(Window.orderBy(key(seed + p, "marker_id"), "marker_id")) - 1  # one row per marker
        ordered = markers.select("marker", place.alias("place"), F.count("*").over(Window.partitionBy()).alias("n"))
        used = ordered.filter(F.col("place") < F.floor(F.col("n") / size) * size)
        used = used.select(
            "marker", (F.expr(f"place div {size}") + F.lit(p) * F.floor(F.col("n") / size)).cast("int").alias("chunk"),
            F.pow(F.lit(3.0), F.col("place") % size).cast("bigint").alias("weight")
        )
        found = used if found is None else found.unionByName(used)
    rows = genotypes.join(found, "marker")
    return rows.groupBy("acc_id", "chunk").agg(
        F.when(F.count_if(F.col("dosage").isNull()) == 0, F.sum(F.col("dosage") * F.col("weight"))).alias("pattern")
    )


MATCH_BLOCK, STRIP, SPARSE = 2048, 512, 8
MATCH = "q_id string, m_id string, matches bigint, q_ok bigint, m_ok bigint, chunks bigint"


def _lists(column: pa.Array, fill: int) -> np.ndarray:
    """Rows of numbers, made equally long with `fill`."""
    ends = column.offsets.to_numpy()
    length, values = np.diff(ends), column.values.to_numpy()
    if len(length) and length.min() == length.max():
        return values[ends[0] : ends[-1]].reshape(len(length), -1)
    out = np.full((len(length), length.max(initial=0)), fill, np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = values[ends[0] : ends[-1]]
    return out


def _add_matches(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """One more in found[i, j] where a[i] = b[j]; below 0 is missing."""
    values, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    low = np.searchsorted(values, 0)
    x, y = code[: len(a)] - low, code[len(a) :] - low
    n = len(values) - low
    times = np.bincount(y[y >= 0], minlength=n)
    rows = np.flatnonzero(x >= 0)
    each = times[x[rows]]
    if each.sum() * SPARSE < found.size:  # rare patterns: an inverted index of one side
        order = np.argsort(y, kind="stable")[np.count_nonzero(y < 0) :]
        begins = np.cumsum(times) - times
        spot = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[x[rows]], each)
        found[np.repeat(rows, each), order[spot]] += 1
    else:
        kind = np.min_scalar_type(-max(1, n) - 1)
        found += np.where(x >= 0, x, -2).astype(kind)[:, None] == np.where(y >= 0, y, -1).astype(kind)[None, :]


def _matching(keep: Callable | None):
    """Pairs of a pair of blocks that share a pattern, with the number of chunks in which they do; `keep` gets those numbers, both sides'
    known chunks and the query's chunks, and says which pairs become rows."""

    def run(cell: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(cell)).combine_chunks()
        side, ok, chunks = (table.column(c).to_numpy() for c in ("side", "ok", "chunks"))
        ids, patterns = table.column("acc_id").combine_chunks(), _lists(table.column("patterns").combine_chunks(), -1)
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
        one = not side.any()
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            found = np.zeros((len(rows), len(right)), np.int32)
            for c in range(patterns.shape[1]):
                _add_matches(found, patterns[rows, c], patterns[right, c])
            wanted = found > 0
            if one:
                wanted &= place[rows][:, None] > place[right][None, :]
            i, j = np.nonzero(wanted)
            x, y, n = rows[i], right[j], found[i, j].astype(np.int64)
            q, m = np.where(place[x] > place[y], (x, y), (y, x))
            if keep is not None:
                good = keep(n, ok[q], ok[m], chunks[q])
                q, m, n = q[good], m[good], n[good]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(q)), ids.take(pa.array(m)), *(pa.array(v) for v in (n, ok[q], ok[m], chunks[q]))],
                names=["q_id", "m_id", "matches", "q_ok", "m_ok", "chunks"]
            )

    return run


def _matches(patterns: DataFrame, keep: Callable | None = None) -> DataFrame:
    """Pairs (q_id > m_id) that share a pattern, by a triangle of block pairs: a pair is formed in one task and is no row before `keep`
    wants it."""
    rows = patterns.filter("acc_id is not null").groupBy("acc_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "pattern"))).alias("s"), F.count("pattern").alias("ok"), F.count("*").alias("chunks"),
        F.max("chunk").alias("top")
    )
    known = F.map_from_entries("s")  # a chunk without a row is missing
    each = F.when(F.size("s") == F.col("top") + 1, F.transform("s", lambda x: x["pattern"])).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("top").cast("int")), lambda i: F.try_element_at(known, i))
    )
    filled = F.transform(each, lambda x: F.coalesce(x, F.lit(-1)).cast("bigint")).alias("patterns")
    wide = checkpoint(rows.select("acc_id", filled, "ok", "chunks"))
    sweep(patterns.sparkSession)
    return grid(wide, MATCH_BLOCK, grow=True).groupBy("bi", "bj").applyInArrow(_matching(keep), MATCH)


def chunk_matches(patterns: DataFrame) -> DataFrame:
    """For each pair (q_id > m_id) that shares a pattern, the number of chunks in which it does. A task holds two blocks of
    accessions, with an inverted index of a chunk's patterns where they are rare."""
    return _matches(patterns).select("q_id", "m_id", "matches")


def chunk_statistics(patterns: DataFrame) -> DataFrame:
    """Chunks and accessions, pairs per chunk possible, lost to missing data, and matching."""
    per = patterns.groupBy("chunk").agg(F.count("*").alias("n"), F.count("pattern").alias("ok"))
    match = patterns.filter("pattern is not null").groupBy("chunk", "pattern").agg(F.count("*").alias("k")).groupBy("chunk").agg(
        F.sum(F.expr("k * (k - 1) div 2")).alias("matching")
    )
    return per.join(match, "chunk", "left").select(
        "chunk", F.expr("n * (n - 1) div 2").alias("possible"), F.expr("n * (n - 1) div 2 - ok * (ok - 1) div 2").alias("lost"),
        F.coalesce("matching", F.lit(0)).cast("bigint").alias("matching")
    )


def estimated_pairs(
    genotypes: DataFrame, max_distance: float = 0.2, size: int = 7, passes: int = 1, seed: int = 1, prefilter: bool = True
) -> DataFrame:
    """Pairs with enough matching chunks, and agmr as estimated from them: 1 - (matches / usable)^(1/size). Approximate: see the
    recall test."""
    patterns = checkpoint(chunk_patterns(genotypes, size, passes, seed))
    sweep(genotypes.sparkSession)
    least = (1 - max_distance) ** size if prefilter and max_distance < 1 else None
    wanted = None if least is None else lambda n, q_ok, m_ok, chunks: n >= least * (q_ok * m_ok / chunks)
    rows = _matches(patterns, wanted).select(
        "q_id", "m_id", "matches", ratio(F.col("q_ok") * F.col("m_ok"), F.col("chunks")).alias("usable")
    )
    return rows.withColumn("est_agmr", F.greatest(F.lit(0.0), F.round(1 - F.pow(F.col("matches") / F.col("usable"), F.lit(1.0 / size)), 6)))


MASK_BYTES, MASK_ROW = 64 << 20, 128


def filtered_pairs(genotypes: DataFrame, max_distance: float = 0.2, size: int = 7, passes: int = 1, seed: int = 1) -> DataFrame:
    """The prefilter's pairs, verified exactly with bit counts. Up to MASK_BYTES of masks are broadcast, so that pairs are not
    dealt anew for either side's."""
    wide = _wide(genotypes).select("acc_id", F.struct(*NAMES).alias("x"))
    n, words = wide.agg(F.count("*"), F.coalesce(F.max(F.size("x.m0")), F.lit(0))).first()
    sweep(genotypes.sparkSession)
    masks = F.broadcast(wide) if n * (len(NAMES) * 8 * words + MASK_ROW) <= MASK_BYTES else wide
    found = estimated_pairs(genotypes, max_distance, size, passes, seed)
    both = found.join(
        masks.select(F.col("acc_id").alias("q_id"), F.col("x").alias("a")), "q_id"
    ).join(masks.select(F.col("acc_id").alias("m_id"), F.col("x").alias("b")), "m_id")
    return with_ratios(with_counts(both)).drop("a", "b").filter(F.col("agmr") <= max_distance)


def _with_phases(genotypes: DataFrame, wide: DataFrame) -> DataFrame:
    """wide with masks of the two phases (p0, p1), markers in order of their chromosomes, and of the places at which a chromosome begins."""
    markers = genotypes.groupBy("marker").agg(F.min("chrom").alias("chrom"))
    along = Window.orderBy("chrom", "marker")  # one row per marker
    before = F.lag("chrom").over(along)
    placed = checkpoint(
        markers.select(
            "marker", (F.row_number().over(along) - 1).alias("place"),
            ((F.row_number().over(along) == 1) | ~before.eqNullSafe(F.col("chrom"))).alias("begins")
        )
    )
    phase = F.when(F.col("phase") == 1, 0).when(F.col("phase") == -1, 1)
    rows = genotypes.select("acc_id", "marker", phase.alias("dosage")).join(placed.select("marker", "place"), "marker")
    masks = pack(rows.select("acc_id", F.col("place").alias("marker"), "dosage"))
    begins = pack(placed.select(F.lit("").alias("acc_id"), F.col("place").alias("marker"), F.col("begins").cast("int").alias("dosage")))
    masks = masks.select("acc_id", F.col("m0").alias("p0"), F.col("m1").alias("p1"))
    return wide.join(masks, "acc_id").crossJoin(F.broadcast(begins.select(F.col("m1").alias("begins"))))  # one row


def _switches(a: list[np.ndarray], b: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(switches, chances, n_agree, markers phased in both) of pairs of rows of masks."""
    bits_ = lambda words: np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little").view(bool)
    chrom = np.cumsum(bits_(begins))
    agree = bits_((a[0] & b[0]) | (a[1] & b[1]))
    pair, marker = np.nonzero(bits_((a[0] | a[1]) & (b[0] | b[1])))
    same = agree[pair, marker]
    follows = (pair[1:] == pair[:-1]) & (chrom[marker[1:]] == chrom[marker[:-1]])
    times = lambda p: np.bincount(p, minlength=len(agree))
    return times(pair[1:][follows & (same[1:] != same[:-1])]), times(pair[1:][follows]), agree.sum(axis=1), times(pair)


BITS_AT_ONCE = 1 << 22


def _phase_kernel(keep):
    """The pairs that `_kernel` gives, with how their phases agree, worked out where both accessions are at hand."""
    found_pairs = _kernel(keep)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        met = found_pairs(cell)
        place = pd.Index(cell["acc_id"])
        q, m = place.get_indexer(met["q_id"]), place.get_indexer(met["m_id"])
        masks = [np.array(cell[c].tolist(), dtype=np.int64).view(np.uint64) for c in ("p0", "p1")]
        begins = np.array(cell["begins"].iloc[0], dtype=np.int64).view(np.uint64)
        step = max(1, BITS_AT_ONCE // (64 * max(1, len(begins))))
        parts = [
            _switches([x[q[at : at + step]] for x in masks], [x[m[at : at + step]] for x in masks], begins)
            for at in range(0, len(q), step)
        ]
        columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for k in range(4)]
        out = pd.DataFrame({"q_id": met["q_id"], "m_id": met["m_id"]} | dict(zip(("switches", "chances", "n_agree"), columns, strict=False)))
        return out[columns[3] > 0]

    return run


def similar_phase_switches(genotypes: DataFrame, max_distance: float) -> DataFrame:
    """`phase_switches` of all similar pairs, from the same block join: neither pairs nor their markers become rows of a join. A
    marker has one chromosome. Phases are 1 and -1."""
    found = grid(checkpoint(_with_phases(genotypes, _wide(genotypes)))).groupBy("bi", "bj")
    return found.applyInPandas(_phase_kernel(_near(max_distance)), "q_id string, m_id string, switches bigint, chances bigint, n_agree bigint")


def phase_switches(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """For given pairs (q_id, m_id), how often agreement of phase changes along a chromosome, over markers phased in both; d is
    the number of chances."""
    phased = genotypes.filter("phase is not null").select("acc_id", "marker", "chrom", "phase")
    rows = pairs.select("q_id", "m_id").join(phased.withColumnsRenamed({"acc_id": "q_id", "phase": "p"}), "q_id").join(
        phased.select(F.col("acc_id").alias("m_id"), "marker", F.col("phase").alias("r")), ["m_id", "marker"]
    )
    along = Window.partitionBy("q_id", "m_id", "chrom").orderBy("marker")
    rows = rows.withColumn("agree", F.col("p") == F.col("r")).withColumn("before", F.lag("agree").over(along))
    return rows.groupBy("q_id", "m_id").agg(
        F.count_if(F.col("agree") != F.col("before")).alias("switches"), F.count("before").alias("chances"),
        F.count_if("agree").alias("n_agree")
    )


def ordered(pairs: DataFrame) -> DataFrame:
    """By query, then agmr, then match."""
    return pairs.orderBy("q_id", "agmr", "m_id")
