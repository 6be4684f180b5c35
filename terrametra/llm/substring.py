"""Removal of repeated passages with prefix-partitioned suffix trees.

A suffix starts at every word that opens a window of ``window`` words. Suffixes are split by a prefix of variable length:
it runs from the suffix's first word through its anchor, the ``ANCHOR``-word sequence with the smallest hash in the
window. Equal windows have equal anchors at equal places, so they always meet in one group, and the neighbouring
suffixes that share an anchor travel as one span of words instead of one row each. Anchors that occur once are leaves
and are dropped before any text moves. A group too large for one task gets a longer prefix, the whole window.

Each remaining group is a subtree, built as its sorted suffixes with the common prefix lengths of neighbours; the runs
of neighbours with a common prefix of at least ``window`` words are its deep internal nodes, that is the repeats.
Spans equal as a whole are settled by counting, without their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrametra.llm.components import dealt_anew
from terrametra.llm.words import row_schema, slices, word_blocks
from terrametra.session import work_path

WINDOW = 35
ANCHOR = 8
# Distinct spans of one anchor that one task takes; beyond, suffixes are dealt out by their whole windows.
GROUP = 512
# Words that are worked on at once; documents are joined up to this size, a longer one is taken alone.
WORDS = 1 << 19
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_PLACE = 28


def word_codes(text: str | None) -> np.ndarray:
    """The 64-bit code of each word."""
    blocks = [np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws)) for ws in word_blocks((text or "").encode())]
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)


class Rolling:
    """Hashes of any word ranges of one code array; they depend on the codes alone, not on the place."""

    def __init__(self, codes: np.ndarray):
        powers = np.full(len(codes) + 1, _MUL, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(len(codes) + 1, _INV, np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_of(codes: np.ndarray, ends: np.ndarray, window: int, anchor: int):
    """Spans of documents laid end to end: anchor hash, span hash, first word, anchor's offset in it, and windows.

    ``ends[i]`` is the end of the document that holds word i. A span covers the consecutive windows of one anchor.
    """
    n, width = len(codes), window - anchor + 1
    if n < window:
        return [np.zeros(0, np.int64)] * 5
    rolling, at = Rolling(codes), np.arange(n - anchor + 1)
    value = rolling.of(at, at + anchor)
    key = (value >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at.astype(np.uint64)
    low, reach = key, 1
    while 2 * reach <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    starts = np.flatnonzero(np.arange(len(low)) + window <= ends[: len(low)])
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    place = (low[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first, count = starts[new], np.diff(np.concatenate([new, [len(starts)]]))
    spot = place[new]
    whole = mixed(rolling.of(first, first + count - 1 + window) + ((spot - first) * 64 + count).astype(np.uint64) * np.uint64(_MUL))
    return [value[spot].view(np.int64), whole.view(np.int64), first, spot - first, count]


def _joined(batches, texts: int):
    """Runs of consecutive rows of about ``WORDS`` words: the rows' places in the batch, their codes, and their starts."""
    for batch in batches:
        rows, held, size = [], [], 0
        for i in range(batch.num_rows):
            codes = word_codes(batch.column(texts)[i].as_py())
            rows.append(i)
            held.append(codes)
            size += len(codes)
            if size >= WORDS or i == batch.num_rows - 1:
                yield batch, rows, np.concatenate(held), np.cumsum([0, *map(len, held)])
                rows, held, size = [], [], 0


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row per span: ``v`` (anchor), ``sh`` (whole span), the text's key ``k, n`` and ``spot`` (place and shape)."""

    def run(batches):
        for batch, rows, codes, starts in _joined(batches, 2):
            lengths = np.diff(starts)
            v, sh, first, off, count = spans_of(codes, np.repeat(starts[1:], lengths), window, anchor)
            row = np.searchsorted(starts, first, side="right") - 1
            spot = ((first - starts[row]) << 12) | (off << 6) | count
            take = pa.array(np.array(rows)[row])
            out = [pa.array(v), pa.array(sh), batch.column(0).take(take), batch.column(1).take(take), pa.array(spot)]
            yield pa.RecordBatch.from_arrays(out, names=["v", "sh", "k", "n", "spot"])

    return docs.select("k", "n", "text").mapInArrow(run, "v bigint, sh bigint, k bigint, n int, spot bigint")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: read several times, and half as large as a checkpoint."""
    folder = work_path(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _span_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` with the list of spans wanted from each, as ``at: array<struct<v, sh, spot>>``."""
    lists = wanted.groupBy("k", "n").agg(F.collect_list(F.struct("v", "sh", "spot")).alias("at"))
    return texts.join(dealt_anew(lists, "k"), ["k", "n"]).select("text", "at")


def _wanted(batches):
    """Spans with their words: v, sh, spot, words."""
    for batch in slices(batches):
        for text, at in zip(batch.column(0), batch.column(1)):
            words = [w for ws in word_blocks((text.as_py() or "").encode()) for w in ws]
            for s in at.as_py():
                yield s["v"], s["sh"], s["spot"], words


def span_words(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``v, sh, spot, words``: the spans' words joined by a blank; equal texts give a span once per row."""

    def run(batches):
        rows = []

        def batch():
            cols = zip(*rows)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["v", "sh", "spot", "words"])

        for v, sh, spot, words in _wanted(batches):
            lo, count = spot >> 12, spot & 63
            rows.append((v, sh, spot, b" ".join(words[lo : lo + count - 1 + window])))
            if len(rows) >= 4096:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return _span_rows(texts, wanted).mapInArrow(run, "v bigint, sh bigint, spot bigint, words binary")


def window_hashes(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``v, sh, i, w``: the hash of each window of the wanted spans, the longest prefix that decides a repeat."""

    def run(batches):
        for v, sh, spot, words in _wanted(batches):
            lo, count = spot >> 12, spot & 63
            codes = np.fromiter(map(xxh64_intdigest, words[lo : lo + count - 1 + window]), np.uint64)
            at = np.arange(count)
            w = Rolling(codes).of(at, at + window).view(np.int64)
            cols = [pa.array(np.full(count, v)), pa.array(np.full(count, sh)), pa.array(at), pa.array(w)]
            yield pa.RecordBatch.from_arrays(cols, names=["v", "sh", "i", "w"])

    return _span_rows(texts, wanted).mapInArrow(run, "v bigint, sh bigint, i bigint, w bigint")


def repeats_in_groups(v: np.ndarray, shape: np.ndarray, spans: list[bytes], window: int) -> np.ndarray:
    """For each span, the bit set of its windows that also start in another span of the same anchor.

    ``v`` names the group and ``shape`` holds ``offset << 6 | windows``. Suffixes are sorted by group, prefix and words
    (by hash first), and neighbours are compared word by word up to the depth ``window``.
    """
    off, count = shape >> 6 & 63, shape & 63
    codes = [np.fromiter(map(xxh64_intdigest, s.split()), np.uint64) for s in spans]
    base = np.cumsum([0, *map(len, codes)])[:-1]
    codes = np.concatenate(codes)
    owner = np.repeat(np.arange(len(spans)), count)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = base[owner] + index
    path = Rolling(codes).of(start, start + window)
    order = np.lexsort((path, off[owner] - index, v[owner]))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((v[owner[a]] == v[owner[b]]) & (off[owner[a]] - index[a] == off[owner[b]] - index[b]) & (path[a] == path[b]))
    deep = np.ones(len(near), bool)
    for j in range(window):  # the common prefix of two neighbours reaches depth j
        deep &= codes[start[a[near]] + j] == codes[start[b[near]] + j]
    hit = np.zeros(len(owner), bool)
    hit[a[near[deep]]] = True
    hit[b[near[deep]]] = True
    out = np.zeros(len(spans), np.int64)
    np.bitwise_or.at(out, owner[hit], np.int64(1) << index[hit])
    return out


def subtree_repeats(spans: DataFrame, window: int) -> DataFrame:
    """``v, sh, mask`` for the spans that hold repeats; groups of an anchor are taken whole, many of them at once."""

    def run(batches):
        held: list[tuple] = []

        def solve(rows):
            v, sh, shape, words = zip(*rows)
            mask = repeats_in_groups(np.array(v, np.int64), np.array(shape, np.int64) & 4095, list(words), window)
            keep = np.flatnonzero(mask)
            cols = [np.array(v, np.int64)[keep], np.array(sh, np.int64)[keep], mask[keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["v", "sh", "mask"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= 4096:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield solve(held[:cut])
                    held = held[cut:]
        if held:
            yield solve(held)

    return spans.repartition("v").sortWithinPartitions("v").mapInArrow(run, "v bigint, sh bigint, mask bigint")


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """``k, n, at``: for each text that holds repeats, its spans ``struct<lo, mask>`` with the repeated windows' bits."""
    found = anchors(texts, window, anchor)
    shared = found.groupBy("v").agg(F.count("*").alias("c"), F.min("sh").alias("a"), F.max("sh").alias("b")).filter("c > 1")
    members = written(found.join(dealt_anew(shared.select("v", (F.col("a") == F.col("b")).alias("alike")), "v"), "v"), "spans")
    full = F.expr("shiftleft(1L, int(spot & 63L)) - 1L")
    kinds = written(
        members.filter(~F.col("alike"))
        .groupBy("v", "sh")
        .agg(F.count("*").alias("c"), F.min(F.struct("k", "n", "spot")).alias("r"))
        .select("v", "sh", "c", "r.*"),
        "kinds",
    )
    hot = kinds.groupBy("v").agg(F.count("*").alias("spans")).filter(F.col("spans") > group).select("v")
    large = kinds.join(dealt_anew(hot, "v"), "v", "left_semi")
    small = kinds.join(dealt_anew(hot, "v"), "v", "left_anti")
    once = span_words(texts, small, window).groupBy("v", "sh").agg(F.min("spot").alias("spot"), F.first("words").alias("words"))
    masks = subtree_repeats(once, window)
    suffixes = window_hashes(texts, large, window).distinct()
    twice = suffixes.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    bit = F.bit_or(F.expr("shiftleft(1L, int(i))")).alias("mask")
    masks = masks.unionByName(suffixes.join(dealt_anew(twice, "w"), "w", "left_semi").groupBy("v", "sh").agg(bit))
    known = kinds.join(masks, ["v", "sh"], "left").select(
        "v", "sh", F.when(F.col("c") > 1, full).otherwise(F.col("mask")).alias("mask")
    )
    known = known.filter(F.col("mask").isNotNull())
    parts = members.filter("alike").select("k", "n", "spot", full.alias("mask"))
    parts = parts.unionByName(
        members.filter(~F.col("alike")).join(dealt_anew(known, "v", "sh"), ["v", "sh"]).select("k", "n", "spot", "mask")
    )
    lo = F.shiftright("spot", 12).alias("lo")
    return parts.groupBy("k", "n").agg(F.collect_set(F.struct(lo, "mask")).alias("at"))


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The text with the key ``k, n`` that stands for it: two hashes of its content, so equal texts share their repeats."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"k": F.xxhash64(text), "n": F.hash(text), "text": text})


def removed_words(n: int, at: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of ``n`` words some repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for lo, mask in at:
        while mask:
            low = mask & -mask
            mask ^= low
            s = lo + low.bit_length() - 1
            edge[s] += 1
            edge[s + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    group: int = GROUP,
    as_is: bool = False,
) -> DataFrame:
    """Per input row ``<id_col>, n_words, n_removed, kept``: the words that no repeated window covers, joined by blanks.

    With ``as_is`` a text that loses no word is kept as it was, white space included.

    A window is ``window`` consecutive words of one text; it is repeated if its word sequence also starts anywhere else,
    in the same text or in another row, equal rows included. Null texts have no words, ``kept`` is then empty; short
    texts have no window and stay whole. Null and repeated ids do not matter: texts meet by content. Every group that
    one task holds is bounded by ``group`` distinct spans; a passage that very many rows share is counted, not gathered.
    """
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col)), text_col).select("k", "n", "id", "text")
    marked = rows.join(dealt_anew(repeated_spans(rows, window, anchor, group), "k"), ["k", "n"], "left")

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, at in zip(batch.column(1), batch.column(2)):
                words = [w for ws in word_blocks(text.as_py().encode()) for w in ws]
                spans = [(s["lo"], s["mask"]) for s in at.as_py() or []]
                gone = removed_words(len(words), spans, window) if spans else np.zeros(len(words), bool)
                if as_is and not spans:
                    kept = text.as_py().encode()
                else:
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((len(words), int(gone.sum()), kept))
            cols = list(zip(*out)) or [(), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "n_words", "n_removed", "kept"]
            )

    schema = row_schema(docs.select(id_col).schema[0].dataType, "n_words bigint, n_removed bigint, kept binary")
    out = marked.select("id", "text", "at").mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
