"""Approximate nearest neighbours by inner product with a forest of hash prefixes.

Vectors get one more component that brings all to the same length, so the largest inner product is the smallest angle.
Each tree hashes a vector to a long string of random-hyperplane signs and keeps the strings of its block sorted. A query
descends in every tree to its longest matching prefix (binary search), then ascends in all trees at once, one sign at a
time, until the ranges of equal prefix hold enough rows; these are scored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrametra.llm.blocks import best_of, met, one_per_id, usable
from terrametra.session import durable

TREES = 32
# Signs of a string, at most 53.
BITS = 48
# Entries of the sorted arrays, over all trees, at which a query stops ascending in a block.
ENTRIES = 6_000
SEED = 11
TOGETHER = 64
# Pairs whose vectors are gathered at once.
PAIRS = 1 << 16


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One integer of ``BITS`` signs per tree and vector."""
    signs = np.einsum("nd,tbd->tnb", vectors, planes, optimize=True) > 0
    return signs @ (1 << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.int64))


def candidates(strings: np.ndarray, asked: np.ndarray, bits: int, entries: int) -> np.ndarray:
    """Queries x rows: whether the forest over ``strings`` (trees x rows) yields the row to the query ``asked``."""
    trees, n = strings.shape
    m = asked.shape[1]
    order = np.argsort(strings, axis=1, kind="stable")
    ordered = np.take_along_axis(strings, order, axis=1)
    longest = np.zeros(m, np.int64)
    for t in range(trees):  # descend: the longest match stands next to the query's place
        at = np.searchsorted(ordered[t], asked[t])
        differ = np.minimum(asked[t] ^ ordered[t][np.maximum(at - 1, 0)], asked[t] ^ ordered[t][np.minimum(at, n - 1)])
        longest = np.maximum(longest, bits - np.frexp(differ.astype(float))[1])
    lo, hi = np.zeros((trees, m), np.int64), np.zeros((trees, m), np.int64)
    rising = np.arange(m)
    for p in range(int(longest.max(initial=0)), -1, -1):  # ascend in all trees at once
        now = rising[longest[rising] >= p]
        head = asked[:, now] >> (bits - p)
        for t in range(trees):
            lo[t, now] = np.searchsorted(ordered[t], head[t] << (bits - p))
            hi[t, now] = np.searchsorted(ordered[t], (head[t] + 1) << (bits - p))
        full = now[(hi[:, now] - lo[:, now]).sum(0) >= min(entries, trees * n)]
        rising = np.setdiff1d(rising, full)
        if not len(rising):
            break
    out = np.zeros((m, n), bool)
    for q in range(m):
        for t in range(trees):
            out[q, order[t, lo[t, q] : hi[t, q]]] = True
    return out


def scored(near: np.ndarray, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of the pairs marked in ``near``; the others are not computed."""
    out = np.full(near.shape, -np.inf)
    r, c = np.nonzero(near)
    for at in range(0, len(r), PAIRS):
        i, j = r[at : at + PAIRS], c[at : at + PAIRS]
        out[i, j] = np.einsum("nd,nd->n", queries[i], vectors[j])
    return out


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    bits: int = BITS,
    entries: int = ENTRIES,
    seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` largest inner products of each query row, ties to smaller ids.

    Every row is indexed; a query meets every block's forest and never its own row. Vectors that are null, zero, or hold a
    null or non-finite component take no part, nor do null ids; rows that share an id count as one, with the smallest
    vector; a shorter vector counts as ending in zeros. Of equal vectors only the ``k + 1`` smallest ids can be
    among the nearest, so only they are kept: a vector that very many rows share costs ``k + 1`` entries.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    used = rows.filter(usable(vector)).select(F.col(id_col), wide.alias("v"), is_query.alias("q"))
    used = used.filter(F.exists("v", lambda x: x != 0.0))
    table = durable(one_per_id(used, id_col, "v"))
    asked = used.filter("q").select(F.col(id_col).cast("long").alias("id")).distinct()
    queries = durable(table.join(asked, "id", "left_semi"))
    copies = Window.partitionBy("vec").orderBy("id")
    kept = durable(table.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"))
    longest = table.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0

    def solve(ids, vectors, query_ids, query_vectors):
        width = vectors.shape[1]
        planes = np.random.default_rng(seed).standard_normal((trees, bits, width + 1))
        lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        strings = hash_strings(np.column_stack([vectors, lift]), planes)
        found = []
        for at in range(0, len(query_ids), TOGETHER):
            q, own = query_vectors[at : at + TOGETHER], query_ids[at : at + TOGETHER]
            near = candidates(strings, hash_strings(np.column_stack([q, np.zeros(len(q))]), planes), bits, entries)
            near &= own[:, None] != ids[None, :]
            scores = scored(near, q, vectors)
            r, c = best_of(scores, near, ids, k)
            found.append((own[r], ids[c], scores[r, c]))
        return [np.concatenate(x) for x in zip(*found)]

    return met(kept, queries, solve, k, "double", F.xxhash64("vec"))
