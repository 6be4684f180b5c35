import numpy as np
from llm_helpers import vectors
from pyspark.sql import functions as F

from terrametra.llm import prefix_forest, topk

ASKED = "vec_id % 20 = 0"
ODD = [(7, None), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 0.0]), (None, [1.0, 1.0])]


def table(n=600, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[200:400] = x[200]  # a third of all rows are copies
    return x


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_top_k_is_exhaustive_with_ties_to_smaller_ids(spark):
    x = table()
    got = answers(topk.top_k(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.expr(ASKED)))
    w = np.floor(64 * x.astype(float)).astype(int)
    for q in range(0, 600, 20):
        s = w @ w[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert got[q] == [(n + 1, i, s[i]) for n, i in enumerate(order)]


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [2.0]), (2, []), (1, [2.0]), *ODD]
    got = answers(topk.top_k(vectors(spark, rows), F.expr(ASKED)))
    assert got == {0: [(1, 1, 64 * 128), (2, 2, 0), (3, 20, 0)], 20: [(1, 0, 0), (2, 1, 0), (3, 2, 0)]}
    assert topk.top_k(vectors(spark, []), F.expr(ASKED)).collect() == []
    assert topk.top_k(vectors(spark, [(0, [1.0])]), F.expr(ASKED)).collect() == []


def test_sparse_and_dense_postings_agree():
    rng = np.random.default_rng(1)
    rows = rng.integers(-5, 6, (50, 9)) * (rng.random((50, 9)) < np.linspace(0.05, 1, 9))
    asked = rng.integers(-5, 6, (7, 9))
    assert (topk.scores_of(rows, asked) == asked @ rows.T).all()


def test_forest_recall_scores_and_copies(spark):
    x = table(3000, 24)
    frame = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = answers(prefix_forest.nearest(frame, F.expr(ASKED), entries=6000))
    y, hits = x.astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        hits += len({i for _, i, _ in found} & set(best))
        assert len(found) == 20
        assert all(abs(sc - s[i]) < 1e-9 for _, i, sc in found)
        assert [(-sc, i) for _, i, sc in found] == sorted((-sc, i) for _, i, sc in found)
    assert len(got) == 150
    assert hits / (150 * 20) >= 0.9


def test_forest_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (3, [2.0, 0.0]), *ODD]
    got = answers(prefix_forest.nearest(vectors(spark, rows), F.expr(ASKED)))
    assert got == {0: [(1, 1, 2.0), (2, 3, 2.0)]}
    assert prefix_forest.nearest(vectors(spark, []), F.expr(ASKED)).collect() == []


def test_forest_ascends_to_the_longest_prefix_with_enough_entries():
    rng = np.random.default_rng(5)
    bits, trees, n = 12, 4, 300
    strings = rng.integers(0, 1 << bits, (trees, n))
    asked = np.column_stack([strings[:, :5], rng.integers(0, 1 << bits, (trees, 6)), np.full(trees, (1 << bits) - 1)])
    for entries in (1, 20, 200, 10_000):
        got = prefix_forest.candidates(strings, asked, bits, entries)
        for q in range(asked.shape[1]):
            for p in range(bits, -1, -1):
                hit = (strings >> (bits - p)) == (asked[:, q] >> (bits - p))[:, None]
                if hit.sum() >= min(entries, trees * n):
                    break
            assert (got[q] == hit.any(0)).all()


def test_forest_scores_candidates_only_and_few_of_clustered_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((80, 32))
    x = centres[rng.integers(0, 80, 4000)] + 0.15 * rng.standard_normal((4000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = rng.random((3, 50)) < 0.3
    pairs = prefix_forest.scored(near, x[:3].astype(float), x[:50].astype(float))
    assert np.allclose(pairs[near], (x[:3].astype(float) @ x[:50].T)[near]) and np.isneginf(pairs[~near]).all()
    wide = np.column_stack([x, np.sqrt(np.maximum((x**2).sum(1).max() - (x**2).sum(1), 0))])
    planes = np.random.default_rng(1).standard_normal((32, 48, 33))
    strings = prefix_forest.hash_strings(wide, planes)
    asked = prefix_forest.hash_strings(np.column_stack([x[:100], np.zeros(100)]), planes)
    assert prefix_forest.candidates(strings, asked, 48, 1000).mean() < 0.1
    frame = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got, y, hits = answers(prefix_forest.nearest(frame, F.expr(ASKED), entries=1000)), x.astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:20]
        hits += len({i for _, i, _ in found} & set(best))
    assert hits / (len(got) * 20) >= 0.9
