"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions (the mean directions of the largest labels). For
an anchor and a row the triangle inequality of angles gives an interval of their cosine from each direction; the
intervals are met, multiplied by both norms and rounded outwards, which bounds the integer score from both sides. Only
rows whose bounds overlap a score window that the anchor asks for are scored, by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrametra.llm.blocks import _matrix, _width, best_of, usable
from terrametra.session import durable

ROWS = 8192
ANCHORS = 2048
# Anchors whose bounds are computed together.
TOGETHER = 64
REFERENCES = 16
# Arc cosines are off by about 1e-8 near zero; cosines of sums of two of them by less than this.
SLACK = 1e-6


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``; by floating point only where every sum is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the angle of every vector to every direction; a zero vector has angle 0 (its scores are 0)."""
    v = vectors.astype(float)
    norms = np.linalg.norm(v, axis=1)
    cosines = (v / np.where(norms > 0, norms, 1)[:, None]) @ directions.T
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0.0)


def score_bounds(angles_a: np.ndarray, norms_a: np.ndarray, angles_b: np.ndarray, norms_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs, safe against rounding.

    Two vectors at angles s and t to a direction are at an angle between ``|s - t|`` and ``min(s + t, 2 pi - s - t)``.
    """
    low = np.full((len(norms_a), len(norms_b)), -1.0)
    high = np.ones_like(low)
    for r in range(angles_a.shape[1]):
        s, t = angles_a[:, r], angles_b[:, r]
        both, cross = np.multiply.outer(np.cos(s), np.cos(t)), np.multiply.outer(np.sin(s), np.sin(t))
        np.maximum(low, both - cross, out=low)
        np.minimum(high, both + cross, out=high)
    scale = np.multiply.outer(norms_a, norms_b)
    return np.floor((low - SLACK) * scale - SLACK), np.ceil((high + SLACK) * scale + SLACK)


def window_of(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer n with ``low * score <= 100 * n <= high * score``."""
    return -(-low * score // 100), high * score // 100


def directions_of(rows: DataFrame, references: int) -> np.ndarray:
    """Unit mean vectors of the ``references`` largest labels, from sums over all rows; ties to smaller labels."""
    largest = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(references)
    parts = rows.join(F.broadcast(largest.select("label")), "label").select("label", F.posexplode("vec").alias("at", "x"))
    sums = parts.groupBy("label", "at").agg(F.sum(F.col("x").cast("double")).alias("x")).collect()  # labels x components
    width = max((r["at"] for r in sums), default=-1) + 1
    labels = {x: i for i, x in enumerate(sorted({r["label"] for r in sums}))}
    out = np.zeros((len(labels), width))
    for r in sums:
        out[labels[r["label"]], r["at"]] = r["x"]
    norms = np.linalg.norm(out, axis=1)
    return out[norms > 0] / norms[norms > 0, None]


def _in_blocks(rows: DataFrame, anchors: DataFrame, solve, schema: str, block: int, group: int) -> DataFrame:
    """``solve`` over every block of about ``block`` rows with every group of about ``group`` anchors."""
    n, m = rows.count(), anchors.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // group))
    left = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            width = max(_width(a), _width(b))
            parts = solve(a, _matrix(a, width), b, _matrix(b, width))
        cols = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, schema)


def _list(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def positives(table: DataFrame, anchors: DataFrame, k: int, block: int = ROWS, group: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the ``k`` best rows of each anchor's label, ties to smaller ids."""

    def solve(a, rows, b, queries):
        ids, labels, asked, wanted = (t[c].to_numpy() for t in (a, b) for c in ("id", "label"))
        for label in np.unique(wanted):
            mine, same = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
            for at in range(0, len(mine) if len(same) else 0, TOGETHER):
                now = mine[at : at + TOGETHER]
                scores = exact_products(queries[now], rows[same])
                r, c = best_of(scores, None, ids[same], k + 1)
                other = asked[now[r]] != ids[same[c]]
                r, c = r[other], c[other]
                yield asked[now[r]], ids[same[c]], scores[r, c]

    found = _in_blocks(table, anchors, solve, "anchor_id bigint, positive_id bigint, positive_score bigint", block, group)
    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    k_positive: int = 5,
    k_negative: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    references: int = REFERENCES,
    block: int = ROWS,
    group: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` per anchor, positive and negative.

    Components become ``floor(scale * x)``; a score is the integer inner product with the anchor, higher scores first and
    ties to smaller ids. An anchor's positives are its first ``k_positive`` other rows of the same label. A row of another
    label is a negative of a positive if ``low * p <= 100 * n <= high * p`` for their scores p and n; the first
    ``k_negative`` are returned (none for a positive score below zero). A row with a null id, label or vector, or with a
    null or non-finite component, takes no part; rows that share an id count as one, with the smallest vector and label.
    A shorter vector counts as ending in zeros, an empty one scores 0. Labels are integers. Products that leave the range
    of a long are not supported. No rows or no anchors give no rows; other columns are not read.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    used = rows.filter(usable(vector) & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    used = used.select(F.col(id_col).cast("long").alias("id"), whole.alias("vec"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    one = used.groupBy("id").agg(F.min(F.struct("vec", "label")).alias("v"), F.max("q").alias("q"))
    plain = durable(one.select("id", "v.vec", "v.label", "q"))
    directions = directions_of(plain, references)

    def measured(batches):
        for batch in batches:
            t = pa.table({"vec": batch["vec"]})
            width = max(_width(t), directions.shape[1])
            wide = np.pad(directions, ((0, 0), (0, width - directions.shape[1])))
            norms, angles = angles_to(_matrix(t, width), wide)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), pa.array(list(angles), pa.list_(pa.float64()))], names=[*batch.schema.names, "norm", "angles"])

    table = durable(plain.mapInArrow(measured, "id bigint, vec array<bigint>, label bigint, q boolean, norm double, angles array<double>"))
    stored = table.drop("q")
    anchors = table.filter("q").select(*[F.col(c).alias(c) for c in stored.columns])  # columns of its own, for the join
    near = durable(positives(stored.select("id", "vec", "label"), anchors.select("id", "vec", "label"), k_positive, block, group))
    asked = near.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))
    asked = asked.select("id", F.col("p.positive_id").alias("pid"), F.col("p.positive_score").alias("ps"))  # k_positive at most

    def solve(a, rows, b, queries):
        ids, labels, norms, angles = a["id"].to_numpy(), a["label"].to_numpy(), a["norm"].to_numpy(), _list(a["angles"])
        wanted, norms_q, angles_q = b["label"].to_numpy(), b["norm"].to_numpy(), _list(b["angles"])
        pid, ps = (b[c].to_pylist() for c in ("pid", "ps"))
        windows = [window_of(np.array(s, np.int64), low, high) for s in ps]
        least = np.array([w[0].min() for w in windows], float)
        most = np.array([w[1].max() for w in windows], float)
        for at in range(0, len(wanted), TOGETHER):
            now = slice(at, at + TOGETHER)
            under, over = score_bounds(angles_q[now], norms_q[now], angles, norms)
            may = (over >= least[now, None]) & (under <= most[now, None]) & (labels[None, :] != wanted[now, None])
            for i, row in enumerate(may, at):
                at_row = np.flatnonzero(row)
                scores = exact_products(queries[i : i + 1], rows[at_row])[0]
                order = np.lexsort((ids[at_row], -scores))
                down, found = -scores[order], ids[at_row[order]]
                for p, s, lo, hi in zip(pid[i], ps[i], *windows[i]):
                    first, end = np.searchsorted(down, -hi, "left"), np.searchsorted(down, -lo, "right")
                    n = max(0, min(end, first + k_negative) - first)
                    yield [np.full(n, x, np.int64) for x in (b["id"][i].as_py(), p, s)] + [found[first : first + n], -down[first : first + n]]

    spec = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    met = _in_blocks(stored, anchors.join(asked, "id"), solve, spec, block, group)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k_negative)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
