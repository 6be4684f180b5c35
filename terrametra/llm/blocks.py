"""A stated query set against all rows, in blocks: every block of rows meets every group of queries in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 8192
QUERIES = 2048


def usable(vector: str) -> Column:
    """Not null, and every component is a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))


def one_per_id(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vec``: rows that share an id count as one, with the smallest vector; null ids take no part."""
    kept = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"))
    return kept.groupBy("id").agg(F.min("vec").alias("vec"))


def met(rows: DataFrame, queries: DataFrame, solve, k: int, score: str, place: Column, block: int = ROWS, group: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of ``solve`` over all blocks, ties to smaller ids.

    ``solve(ids, vectors, query_ids, query_vectors)`` gets one block of rows and one group of queries as arrays and
    returns query ids, ids and scores, at most a few per query. Blocks and groups are dealt by hash (``place`` for rows),
    so they hold about ``block`` and ``group`` rows whatever the keys are.
    """
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // group))
    left = rows.withColumn("b", F.pmod(place, F.lit(blocks)).cast("int"))
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = pa.int64() if score == "bigint" else pa.float64()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            width = max(_width(a), _width(b))
            q, i, s = solve(a["id"].to_numpy(), _matrix(a, width), b["id"].to_numpy(), _matrix(b, width))
        else:
            q = i = s = np.zeros(0)
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, kind)], names=["query_id", "vec_id", "score"])

    near = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _width(t: pa.Table) -> int:
    lengths = [c for c in t["vec"].chunks if len(c)]
    return max((int(np.diff(c.offsets.to_numpy()).max()) for c in lengths), default=0)


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    column = t["vec"].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), flat.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best_of(scores: np.ndarray, allowed: np.ndarray | None, ids: np.ndarray, k: int):
    """Row and column of the ``k`` largest of each row of ``scores``, ties to smaller ids; ``allowed`` masks the rest out."""
    n = scores.shape[1]
    if allowed is not None:
        scores = np.where(allowed, scores, -np.inf)
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k]
        r, c = np.nonzero(scores >= edge[:, None])
    else:
        r, c = np.nonzero(np.ones(scores.shape, bool))
    if allowed is not None:
        keep = allowed[r, c]
        r, c = r[keep], c[keep]
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]
