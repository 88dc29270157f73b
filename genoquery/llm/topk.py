"""Exact top-k search by block-at-a-time pruning.

Vectors are quantised to whole numbers. Consecutive ids form blocks; a block keeps its vectors (the forward index) and each
term's (dimension's) largest and smallest weight. A query's bound for a block is the sum over terms of its weight times the block's
maximum (minimum, where the query's weight is negative). Blocks are scored in order of falling bounds until the next bound is
below the k-th best score, so every result is exact; a bound equal to it is still scored, as a tie may go to a smaller id.

Queries and blocks meet in a grid of cells of about CELL_QUERIES x CELL_VECTORS rows. Rows of the grid are ranges of (id, a hash of the
vector) with cut points that Spark samples, so ids far apart or one id with a third of the rows give even cells, and a task's memory is
bounded whatever the table's size. Nothing is broadcast or collected; a cell returns k rows per query, which one window merges.

Defined results: rows whose vector is null, or holds a null or non-finite component take no part; an empty vector is a vector of zeros, and
of vectors of different lengths the missing components count as 0. Every row is a candidate of every query but its own, also one with the
same id, and each row whose id is asked for is a query, whose result is its own. Null ids are candidates, after all others in ties. Ties
go to the smaller id, and equal rows are all there. With fewer than k candidates all are returned. Components are clamped to 62 bits and
scores to 63 (sums beyond 64 bits are formed exactly, then clamped). An empty table gives no rows; other columns, whatever their names,
are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from genoquery.checkpoints import checkpoint
from genoquery.llm.common import ship, table

K = 10
SCALE = 1024
BLOCK = 256
CELL_VECTORS = 8192
CELL_QUERIES = 8192
LIMIT = 2**63 - 1


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _kind(queries: np.ndarray, vectors: np.ndarray):
    """A type in which all inner products are exact."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    return np.float64 if top < 2**53 else np.int64 if top < 2**63 else object


def search(
    query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK
) -> list[tuple[int, int, int]]:
    """(query's row, number of the vector, score): each query's k best of the vectors but the one of its own row. The vectors come in
    order of ids; ties go to the first."""
    kind = _kind(queries, vectors)
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = []
    for q, (own, vector) in enumerate(zip(query_rows.tolist(), queries, strict=True)):
        best_scores, best = np.empty(0, kind), np.empty(0, np.int64)
        for b in order[q]:
            if len(best_scores) == k and bounds[q, b] < best_scores[-1]:
                break
            a = starts[b]
            scores, members = vectors[a : a + block] @ vector, np.arange(a, min(a + block, len(ids)))
            keep = rows[members] != own
            if len(best_scores) == k:
                keep &= scores >= best_scores[-1]
            scores, members = np.concatenate((best_scores, scores[keep])), np.concatenate((best, members[keep]))
            first = np.lexsort((members, -scores))[:k]
            best_scores, best = scores[first], members[first]
        found += [(own, n, max(-LIMIT, min(LIMIT, int(s)))) for n, s in zip(best.tolist(), best_scores.tolist(), strict=True)]
    return found


FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.array([], dtype="Int64") for n in names})
        right = right.sort_values(["none", "id", "row"], ignore_index=True)
        width = max(1, max(map(len, left["v"])), max(map(len, right["v"])))
        rows, ids = right["row"].to_numpy(), right["id"].to_numpy()
        found = search(left["row"].to_numpy(), _matrix(left["v"], width), rows, ids, _matrix(right["v"], width), k)
        own, at, scores = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        query_id = dict(zip(left["row"].tolist(), left["id"].tolist(), strict=True))
        vec_id = pd.array(ids[at], dtype="Int64")
        vec_id[right["none"].to_numpy(bool)[at]] = pd.NA
        return pd.DataFrame(
            {"query_row": own, "query_id": np.array([query_id[r] for r in own.tolist()], np.int64), "vec_id": vec_id, "score": scores}
        )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (integer inner product) of each query's k best vectors; is_query is a condition on the
    column `id`."""
    ship(vectors.sparkSession)
    raw = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("e")
    ).filter("e is not null")
    sound = raw.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    top = float(2**62)
    whole = sound.select(
        "id",
        F.transform("e", lambda x: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), x * float(scale)))).cast("bigint")).alias("v")
    )
    size = vectors.count()
    rows, cols = -(-size // CELL_VECTORS) or 1, -(-size // CELL_QUERIES) or 1
    if rows > 1:
        whole = whole.repartitionByRange(rows, F.col("id").asc_nulls_last(), F.xxhash64("v")).withColumn("r", F.spark_partition_id())
    else:
        whole = whole.withColumn("r", F.lit(0))
    # written once, so that a row keeps its cell and its number whoever reads it
    whole = checkpoint(whole, wide=True).withColumn("row", F.monotonically_increasing_id())
    queries = whole.filter(is_query & F.col("id").isNotNull())
    if cols > 1:
        cols = -(-queries.count() // CELL_QUERIES) or 1
    col = F.pmod(F.xxhash64("row"), F.lit(cols)).cast("int")
    left = queries.drop("r").withColumn("c", col).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    right = whole.withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("bigint"))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    )
    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(_cell(k), FOUND)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for each vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.e) > 0 AND len(c.e) > 0 THEN list_dot_product(q.e, c.e)
    ELSE 0 END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
