import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash
from llm_helpers import documents
from pyspark.sql import functions as F

from terrametra.llm import components, mixing, simhash, substring

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(n=150, seed=6):
    """Prose with a shared passage, copies, near copies, empty and null texts, and a very long one."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        t = prose(rng, rng.randint(0, 160))
        if i % 3 == 0:
            t = f"{t} {passage} {prose(rng, 20)}"
        if i % 7 == 0 and rows:
            t = rng.choice(rows)[1]
            if t and i % 14 == 0:
                ws = t.split()
                ws[rng.randrange(len(ws))] = "edited"
                t = " ".join(ws)
        rows.append((i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None])))
    rows += [(n, None, None, None), (n + 1, None, None, "a"), (n + 2, "", "en", "a"), (n + 3, " \t\n", "en", "a"), (None, "null id " * 9, "en", "a")]
    rows += [(5, rows[5][1], "en", "a"), (n + 4, prose(rng, 9000) + " " + passage, "en", "c"), (n + 5, "ab ab " * 400, "en", "b")]
    return rows


def reference_fingerprint(text):
    ws = (text or "").encode().lower().split()
    shs = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups_against_all_pairs(spark):
    rows = corpus()
    fps = [reference_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows))
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.simhash_groups(documents(spark, [])).collect() == []


def test_links_in_tiles_and_wide_radius(spark):
    rng = random.Random(8)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 150:  # one dense bucket, cut into many tiles
        f = centre
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f - (1 << 64) if f >> 63 else f)
    for radius, segments, match in ((2, 4, 2), (3, 5, 2), (4, 6, 2)):
        found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, segments, match, tile=16)
        roots = {r.node: r.root for r in components.components(found).collect()}
        seen, todo = {}, sorted(fps)
        for f in todo:
            if f in seen:
                continue
            stack, members = [f], {f}
            while stack:
                at = stack.pop()
                for g in fps - members:
                    if ((at ^ g) % (1 << 64)).bit_count() <= radius:
                        members.add(g)
                        stack.append(g)
            seen |= dict.fromkeys(members, min(members))
        assert {f: roots.get(f, f) for f in fps} == seen


def test_very_long_text_in_blocks(monkeypatch):
    text = prose(random.Random(3), 500)
    whole = simhash.fingerprint(text)
    from terrametra.llm import words

    monkeypatch.setattr(words.word_blocks, "__defaults__", (64,))
    assert simhash.fingerprint(text) == whole == [reference_fingerprint(text)]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (7, 3), (None, 4), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def without_repeats(texts, window):
    seen = Counter()
    for t in texts:
        ws = (t or "").encode().split()
        seen.update(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    out = []
    for t in texts:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g).decode()))
    return out


def test_repeats_against_all_windows(spark):
    rows = corpus()
    want = Counter((r[0], *x) for r, x in zip(rows, without_repeats([r[1] for r in rows], 35)))
    for group in (substring.GROUP, 2):  # the second sends most groups the way of large ones
        got = substring.without_repeats(documents(spark, rows), group=group).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(n * k[2] for k, n in want.items()) > 3000
    assert substring.without_repeats(documents(spark, [])).collect() == []


def test_repeats_of_few_words_and_small_windows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = substring.without_repeats(documents(spark, rows), window=12, anchor=4).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, without_repeats([r[1] for r in rows], 12)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


def water_fill(sizes, weights, total):
    """Targets by raising one level until the total is met, by bisection."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights)]


def test_mix_meets_targets(spark):
    rows = corpus(400)
    laid, pieces = mixing.mix(documents(spark, rows), block=64)
    got = mixing.taken(laid, pieces).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        assert 0 <= r.taken <= 2 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))))
    for s in names:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]}
        assert all(abs(r.target - aims[s]) < 1e-3 for r in mine)
        assert abs(sum(r.taken for r in mine) - aims[s]) <= 64 + 1e-3
    assert Counter((r.id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    first = {}
    for piece in pieces.collect():
        key = (piece.src, piece.position)
        first[key] = min(first.get(key, piece.slot), piece.slot)
    assert {(r.src, r.position): r.first_slot for r in got if r.first_slot is not None} == first
    again = mixing.taken(*mixing.mix(documents(spark, rows).repartition(5), block=64)).collect()
    key = lambda r: (r.id is None, r.id or 0, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_spreads_sources(spark):
    rows = [(i, prose(random.Random(i), 50), "en", s) for i, s in enumerate(["a", "b", "c"] * 120)]
    laid, pieces = mixing.mix(documents(spark, rows), block=32)
    named = pieces.join(laid.select("src", "position", "source"), ["src", "position"])
    by_slot = [r.source for r in named.groupBy("slot").agg(F.min("source").alias("source")).orderBy("slot").collect()]
    share = Counter(by_slot)
    half = Counter(by_slot[: len(by_slot) // 2])
    assert all(abs(half[s] - share[s] / 2) <= 6 for s in share)


def test_mix_without_words(spark):
    for rows in ([], [(1, None, None, None), (2, "", "en", "a")]):
        laid, pieces = mixing.mix(documents(spark, rows))
        assert [r.taken for r in mixing.taken(laid, pieces).collect()] == [0] * len(rows)


def jaccard(a, b):
    sets = []
    for t in (a, b):
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stages(spark):
    rng = random.Random(12)
    texts = [prose(rng, 200) for _ in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    rows += [(100 + i, t, "en", "b") for i, t in enumerate(texts[:10])]  # copies
    rows += [(200 + i, t + " added at the end", "en", None) for i, t in enumerate(texts[10:20])]  # near copies
    rows += [(0, texts[0], "en", "a"), (300, "123 456", "en", "a"), (301, None, None, None), (None, prose(rng, 50), "en", "a")]
    docs = documents(spark, rows)
    known = corpus_pipeline.keep_known_language(spark, docs, "")
    assert known.columns == docs.columns
    assert Counter(r.doc_id for r in known.collect()) == Counter(r[0] for r in rows if r[0] not in (300, 301))
    kept = corpus_pipeline.drop_near_copies(spark, known, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(40), None])
    assert {r.text for r in kept.filter("doc_id < 40").collect()} == set(texts)
    tail = prose(rng, 50)
    more = documents(spark, [(1, texts[1] + "\n\n" + tail, "en", "a"), (2, tail + " x\ty", "en", "a"), (3, "stays\n as  is", "en", "b"), (4, None)])
    cut = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, more, "").collect()}
    assert cut == {1: texts[1], 2: "x y", 3: "stays\n as  is", 4: None}
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    last = corpus_pipeline.encode_texts(spark, more, "").collect()
    assert {(r.doc_id, r.decoded_sha256) for r in last} == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in more.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), "").collect() == []


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        ws = prose(rng, 300).split()
        rows.append((2 * i, " ".join(ws)))
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(300)] = "other"
        rows.append((2 * i + 1, " ".join(ws)))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()}
    assert {2 * i for i in range(60)} <= kept
    for i in range(60):
        if jaccard(rows[2 * i][1], rows[2 * i + 1][1]) < 0.8:
            assert 2 * i + 1 in kept
    assert sum(2 * i + 1 in kept for i in range(60)) <= 3


def staying(rows):
    """Ids that stay: in id order, whatever is no near copy of one that stays."""
    kept = []
    for i, text in sorted(rows):
        if all(jaccard(text, t) < 0.8 for _, t in kept):
            kept.append((i, text))
    return {i for i, _ in kept}


def test_near_copies_between_0_8_and_0_9(spark):
    rng, rows = random.Random(31), []
    for i in range(60):
        ws = prose(rng, 300).split()
        rows.append((10 * i, " ".join(ws)))
        rows.append((10 * i + 1, " ".join(ws + prose(rng, rng.randint(25, 90)).split())))  # appended
        rows.append((10 * i + 2, " ".join(ws[: rng.randint(220, 280)])))  # cut off
        for at in rng.sample(range(300), rng.randint(3, 9)):  # scattered
            ws[at] = f"other{at}"
        rows.append((10 * i + 3, " ".join(ws)))
    want = staying(rows)
    assert 60 < len(want) < 180
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()} == want


def test_near_copies_of_members_that_stay(spark):
    rng, rows = random.Random(32), []
    ws = prose(rng, 300).split()
    for i in range(60):  # a chain of drifting copies
        rows.append((i, " ".join(ws)))
        ws = ws[3:] + prose(rng, 3).split()
    page = prose(rng, 100).split()  # two clusters that share a third of their words
    for i, own in enumerate((prose(rng, 200), prose(rng, 200))):
        rows += [(100 + 20 * j + i, " ".join([*page, *own.split()[j:]])) for j in range(12)]
    want = staying(rows)
    assert len(want) < 20
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()} == want


def test_run_over_a_folder(spark, tmp_path):
    rows = [(i, f"{prose(random.Random(i), 90)}", "en", "a") for i in range(30)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert np.frombuffer(bytes(got[0].ids), "<u4").max() < 50_256
