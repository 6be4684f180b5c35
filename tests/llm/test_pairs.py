"""The Jaccard join, the tokenizer alignment and the hard negatives against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import documents, vectors
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrametra.llm import alignment, components, hard_negatives, set_join

WORDS = [f"w{i}" for i in range(400)]
SIDES = (path("byte_bpe_50k.json"), PATTERN, path("piece_bpe_32k.model"))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Jaccard join


def set_of(text, words=4):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)) or frozenset([tuple(ws)] if ws else [])


def joined(rows, words=4, percent=85):
    sets = [set_of(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


def edited(rng, text, share):
    ws = text.split()
    for i in range(len(ws)):
        if rng.random() < share:
            ws[i] = rng.choice(WORDS)
    return " ".join(ws)


def crowd(seed=3):
    """Copies, near copies around the threshold, templates, tiny and empty texts, a chain, null and repeated ids."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", " ", "one", "one", "One two", "one two three", "a b c d", "A B c d", "ab " * 300, "ab ab ab ab"]
    for n in (5, 8, 13, 40, 150, 900):
        base = prose(rng, n)
        texts += [base, base] + [edited(rng, base, x) for x in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(3)]
        texts += [base + " " + prose(rng, k) for k in (1, n // 20, n // 8, n // 5)]
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 0.015)
            texts.append(chain)
    page = prose(rng, 120)
    texts += [page + " " + prose(rng, 60) for _ in range(20)] + [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, rows[3][1]), (None, None), (None, "only null ids here " * 3), (2, rows[9][1]), rows[7]]


def test_jaccard_groups_against_all_pairs(spark):
    rows = crowd()
    got = set_join.jaccard_groups(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == joined(rows)
    assert set_join.jaccard_groups(documents(spark, [])).collect() == []


@pytest.mark.parametrize("words,percent", [(2, 60), (5, 95)])
def test_other_thresholds(spark, words, percent):
    rows = crowd(5)
    got = set_join.jaccard_groups(documents(spark, rows), words=words, percent=percent).collect()
    assert Counter(tuple(r) for r in got) == joined(rows, words, percent)


def test_crowded_buckets_in_tiles_and_parts(spark, monkeypatch):
    """Many near copies of one text: small tiles, best pairs first, and buckets handed on in parts."""
    rng = random.Random(8)
    base = prose(rng, 70)
    rows = [(i, edited(rng, base, 0.012)) for i in range(150)]
    monkeypatch.setattr(set_join._across, "__defaults__", (False, 16))
    monkeypatch.setattr(set_join, "HELD", 8)
    monkeypatch.setattr(set_join, "PAIRS", 1)
    monkeypatch.setattr(set_join, "LED", 8)
    got = set_join.jaccard_groups(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == joined(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((20, 3), (300, 40), (4000, 900)):
        found = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        other = np.unique(np.concatenate([found[m:], rng.integers(0, 1 << 63, m, np.uint64)]))
        for bits in (64, 1024):
            apart = np.bitwise_count(set_join.sketch(found, bits).view("u8") ^ set_join.sketch(other, bits).view("u8")).sum()
            assert apart <= len(np.setxor1d(found, other))


def test_bands_hold_all_linked_sizes():
    for percent in (60, 85, 95):
        bands = set_join.Bands(percent)
        for n in range(1, 3000):
            assert bands.of(bands.largest_partner(n)) <= bands.of(n) + 1
            bits, words, spare = bands.scheme(bands.of(n))
            bound = bands.most_different(n + bands.largest_partner(n))
            assert bits and (words > bound + spare or not bound)


def test_long_texts_and_long_paths(spark):
    rng = random.Random(4)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, edited(rng, long, 0.01)), (3, prose(rng, 50_000)), (4, long + " tail")]
    got = {r.doc_id: r.component_id for r in set_join.jaccard_groups(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    ids = random.Random(1).sample(range(1 << 40), 700)
    path_ = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r.root for r in components.components(path_).collect()} == {min(ids)}


# Alignment of tokenizers


def aligned(rows):
    """Brute force with the public libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    from terrametra.llm.token_files import _byte_letters

    a, b = Tokenizer.from_file(SIDES[0]), sentencepiece.SentencePieceProcessor(model_file=SIDES[2])
    a.encode_special_tokens = True
    back = {chr(v): k for k, v in _byte_letters().items()}
    out, counts, best = [], Counter(), defaultdict(int)
    for doc, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        pieces = [b.id_to_piece(i) for i in ib]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces)]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            out.append((doc, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        links = [(x, y) for x, p in zip(ia, ends_a) for y, q in zip(ib, ends_b) if p == q] if len(ia) < 400 else [(x, ib[ends_b.index(p)]) for x, p in zip(ia, ends_a) if p in set(ends_b)]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, lo = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, p in zip(ia, ends_a) if lo < p <= cut) + "|" + ",".join(str(y) for y, q in zip(ib, ends_b) if lo < q <= cut))
            lo = cut
        counts.update(links)
        out.append((doc, ia, ib, links, ";".join(groups)))
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    for doc, ia, ib, links, text in out:
        n = [counts[x] for x in links]
        yield doc, len(ia), len(ib), text.count(";") + 1 if text else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(n), hashlib.sha256(text.encode()).hexdigest() if text else ""


TEXTS = [
    "plain words, and more words", "", None, "a", " ", "  two  blanks  ", "tab\tand\nline", "<|endoftext|> and <s> <unk> <0x41>", "naïve café 漢字 🙂🙂", "▁ lower block", "ﬁ ligature ﬃ", "I'm here 12345 !!??",
    "x" * 300, "\u0000 zero", "é combining", "aaaa bbbb " * 40, "plain words, and more words", " nbsp em", "\r\nend \n",
]


def test_alignment_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(rng, 30) + " " + rng.choice(TEXTS[3:15])) for i in range(30)]
    rows += [(None, "null id"), (3, "repeated id"), (3, "repeated id")]
    want = Counter(aligned(rows))
    assert Counter(tuple(r) for r in alignment.align(documents(spark, rows), SIDES).collect()) == want
    monkeypatch.setattr(alignment, "SLICE", 50)  # many slices a task
    monkeypatch.setattr(alignment._batches, "__defaults__", (60,))
    assert Counter(tuple(r) for r in alignment.align(documents(spark, rows), SIDES).collect()) == want
    assert alignment.align(documents(spark, []), SIDES).collect() == []
    assert [tuple(r)[1:] for r in alignment.align(documents(spark, [(1, None)]), SIDES).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_overlaps_are_all_pairs_of_ranges():
    sides = alignment._sides(SIDES)
    got = alignment.Aligned(sides, [t for t in TEXTS if t] + [prose(random.Random(1), 50)])
    (a0, a1), (b0, b1) = got.a_spans, got.b_spans
    want = {(i, j) for i in range(len(a0)) for j in range(len(b0)) if a0[i] < b1[j] and b0[j] < a1[i]}
    assert set(zip(got.i.tolist(), got.j.tolist())) == want and len(got.i) == len(want)


def test_groups_give_back_the_text(spark):
    sides = alignment._sides(SIDES)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = defaultdict(list)
    for r in alignment.groups(documents(spark, rows), SIDES).collect():
        found[r.doc_id].append(r)
    good = 0
    for i, t in rows:
        parts = sorted(found[i], key=lambda r: r.nth)
        if parts:
            whole, good = (" " + t).encode(), good + 1
            assert [r.nth for r in parts] == list(range(len(parts)))
            for r in parts:
                assert whole[r.start : r.end] == b"".join(sides[0].bytes_of[x] for x in r.a_ids) == b"".join(sides[1].bytes_of[x] for x in r.b_ids)
            assert parts[0].start == 0 and parts[-1].end == len(whole)
    assert good > 10


# Hard negatives


def mined(rows, k=5, n=10, low=30, high=90):
    one = {}
    for i, v, label, q in rows:
        if i is None or label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        had = one.get(i)
        one[i] = (min(had[0], (w, label)) if had else (w, label), q or bool(had and had[1]))
    out = []
    for a, ((va, la), q) in one.items():
        if not q:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, ((v, _), _) in one.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0][1] == la][:k]:
            fit = [i for i in order if one[i][0][1] != la and low * score[p] <= 100 * score[i] <= high * score[p]][:n]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


KIND = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("q", T.BooleanType()), T.StructField("id", T.StringType()), T.StructField("norm", T.StringType()),
    ]
)


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 12))
    rows = []
    for i in range(160):
        v = centres[i % 4] + rng.normal(size=12) * 0.7
        rows.append((i, (v / np.linalg.norm(v)).tolist(), i % 4, i % 9 == 0))
    rows += [(200, None, 1, True), (201, [1.0, None], 1, True), (202, [float("nan")] * 12, 1, False), (203, [float("inf")] * 12, 1, False), (204, [0.0] * 12, 2, True)]
    rows += [(None, [1.0] * 12, 1, True), (205, [], 1, True), (206, [0.5, 0.5], 3, True), (207, [-1.0] * 12, None, True), (9, rows[9][1], 0, True), (208, [1.0] * 12, 99, True)]
    rows += [(300 + i, rows[5][1], 7, i == 0) for i in range(12)] + [(400, rows[5][1], 1, True)]  # ties, equal vectors
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)
    want = mined(rows)
    for block, group in ((8192, 2048), (16, 5)):
        got = hard_negatives.hard_negatives(table, F.col("q"), block=block, group=group)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert hard_negatives.hard_negatives(table.limit(0), F.col("q")).collect() == []
    assert hard_negatives.hard_negatives(table, F.lit(False)).collect() == []


def test_score_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 32))
    v = np.floor(256 * np.concatenate([c + 0.25 * rng.normal(size=(200, 32)) for c in centres])).astype(np.int64)
    v[3] = 0
    unit = centres / np.linalg.norm(centres, axis=1)[:, None]
    norms, angles = hard_negatives.angles_to(v, unit)
    under, over = hard_negatives.score_bounds(angles[:50], norms[:50], angles, norms)
    scores = hard_negatives.exact_products(v[:50], v)
    assert (under <= scores).all() and (scores <= over).all()
    positive = scores[0, 1:200].max()
    lo, hi = hard_negatives.window_of(np.array([positive]), 30, 90)
    assert ((over[0] >= lo) & (under[0] <= hi)).mean() < 0.7  # near the directions the windows are narrow
    assert (hard_negatives.exact_products(v * (1 << 30), v) == scores.dtype.type(1 << 30) * hard_negatives.exact_products(v, v)).all()
