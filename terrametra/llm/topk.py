"""Exact top-k by inner product of integer vectors: exhaustive, term at a time.

Each block of rows is inverted: per component a list of postings (rows where it is not zero, with their weights). A
query goes through its non-zero components and adds weight times postings into one dense score array over the block;
the best of the array come from a partial selection, and the blocks' winners are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.llm.blocks import best_of, met, one_per_id, usable
from terrametra.session import durable

# Queries whose score arrays are selected from together.
TOGETHER = 64


def postings_of(rows: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per component the rows that hold it and their weights; no row list where over half the rows hold it."""
    out = []
    for column in np.ascontiguousarray(rows.T):
        at = np.flatnonzero(column)
        out.append((None, column) if 2 * len(at) > len(column) else (at, column[at]))
    return out


def scores_of(rows: np.ndarray, queries: np.ndarray, postings=None) -> np.ndarray:
    """Integer inner products of every query with every row, accumulated over the query's non-zero components."""
    postings = postings or postings_of(rows)
    out, part = np.zeros((len(queries), len(rows)), rows.dtype), np.empty(len(rows), rows.dtype)
    for scores, query in zip(out, queries):
        for term in np.flatnonzero(query):
            at, weights = postings[term]
            if at is None:
                np.multiply(weights, query[term], out=part)
                scores += part
            else:
                scores[at] += weights * query[term]
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each query row, ties to smaller ids.

    Components become ``floor(scale * x)``. Queries are the rows where ``is_query`` holds; a query meets every row but its
    own. A vector that is null or holds a null or a non-finite component takes no part, nor does a null id; rows that share
    an id count as one, with the smallest vector. A shorter vector counts as ending in zeros, an empty one scores 0
    everywhere. Products that leave the range of a long are not supported.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    used = rows.filter(usable(vector)).select(F.col(id_col), whole.alias("v"), is_query.alias("q"))
    table = durable(one_per_id(used, id_col, "v"))
    asked = used.filter("q").select(F.col(id_col).cast("long").alias("id")).distinct()
    queries = durable(table.join(asked, "id", "left_semi"))

    def solve(ids, vectors, query_ids, query_vectors):
        found = []
        top = float(np.abs(vectors).max(initial=0)) * float(np.abs(query_vectors).max(initial=0)) * max(1, vectors.shape[1])
        kind = np.int32 if top < 2**31 else np.int64
        vectors, query_vectors = vectors.astype(kind), query_vectors.astype(kind)
        postings = postings_of(vectors)
        for at in range(0, len(query_ids), TOGETHER):
            scores = scores_of(vectors, query_vectors[at : at + TOGETHER], postings)
            r, c = best_of(scores, None, ids, k + 1)
            own = query_ids[at + r] == ids[c]
            found.append((query_ids[at + r][~own], ids[c][~own], scores[r, c][~own].astype(np.int64)))
        return [np.concatenate(x) for x in zip(*found)]

    return met(table, queries, solve, k, "bigint", F.xxhash64("id"))
