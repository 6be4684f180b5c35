"""Alignment of two tokenizers' tokens by their byte ranges.

Per batch of documents, both sides' tokens are laid on one line of bytes: a document's key is the place where its bytes
begin, so ranges of different documents never meet. ``pandas.merge_asof`` takes each token start to the other side's
token that covers it, in both directions; the union is all overlaps. Overlaps whose ranges end together are links, and
the ends that both sides share cut a document into groups.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.llm.components import dealt_anew
from terrametra.llm.token_files import _byte_letters
from terrametra.llm.words import row_schema, slices
from terrametra.session import durable, work_path

# Links of one slice of documents; a slice's id pairs are looked up together, so it bounds a task's memory.
SLICE = 1 << 22
# Bytes of text that are aligned together.
BATCH = 1 << 20
PAIR = 1 << 32
_SIDES: dict = {}


class Side:
    """One tokenizer: ``encode(texts)`` gives ids, ``bytes_of[id]`` a token's bytes, ``lengths[id]`` their number."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bytes_of: list[bytes]):
        self.encode, self.bytes_of = encode, bytes_of
        self.lengths = np.array([len(b) for b in bytes_of], np.int64)


def byte_bpe_side(path: str, pattern: str) -> Side:
    """Byte-level BPE of a tokenizers file, with a blank before the text; strings of special tokens are plain text.

    The file's entries in their order are the merge ranks; tiktoken merges each match of ``pattern`` by them.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    letters = {chr(v): k for k, v in _byte_letters().items()}
    special = {t["content"] for t in stored["added_tokens"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in stored["model"]["vocab"].items() if piece not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    coding = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [coding.encode_ordinary(" " + t) for t in texts], table)


def piece_side(path: str) -> Side:
    """A sentencepiece model, which adds the blank itself; U+2581 stands for a blank, ``<0xHH>`` for a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: model.encode(texts, num_threads=1), table)


def _sides(sides: tuple[str, str, str]) -> tuple[Side, Side]:
    if sides not in _SIDES:
        _SIDES[sides] = byte_bpe_side(sides[0], sides[1]), piece_side(sides[2])
    return _SIDES[sides]


@cache
def _shown(ids: int) -> list[bytes]:
    """Every id followed by a comma, a bar or a semicolon."""
    return [b"%d%c" % (i, c) for i in range(ids) for c in b",|;"]


def covering(starts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each start, the index of the other side's token that covers it: the last one that starts at or before it."""
    left, right = pd.DataFrame({"at": starts}), pd.DataFrame({"at": other, "token": np.arange(len(other))})
    return pd.merge_asof(left, right, on="at", direction="backward")["token"].to_numpy()


def overlaps(a_starts: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all tokens whose ranges overlap, in order: the union of both directions, each pair once.

    Both sides cover the same bytes without gaps. A pair that starts together is found from both sides.
    """
    b_of_a, a_of_b = covering(a_starts, b_starts), covering(b_starts, a_starts)
    own = a_starts[a_of_b] != b_starts  # the others are found from side A already
    a = np.concatenate([np.arange(len(a_starts)), a_of_b[own]])
    b = np.concatenate([b_of_a, np.flatnonzero(own)])
    order = np.argsort(a + b, kind="stable")  # overlaps follow each other: every step passes one token's end, or two
    return a[order], b[order]


class Aligned:
    """The aligned tokens of some documents.

    ``a, b``: ids of both sides; ``a_doc, b_doc``: the document of each token; ``i, j``: overlapping token indexes;
    ``same``: which of them end together (the links); ``group_a, group_b``: each token's group, counted over all documents.
    """

    def __init__(self, sides: tuple[Side, Side], texts: list[str | None]):
        self._shown = _shown(max(len(s.bytes_of) for s in sides))
        plain = [t or "" for t in texts]
        ids = [[], []]
        whole = [(" " + t).encode() for t in plain]
        coded = [side.encode(plain) for side in sides]
        for n, t, at_a, at_b in zip(range(len(plain)), plain, *coded):
            good = bool(t) and all(b"".join(map(s.bytes_of.__getitem__, x)) == whole[n] for s, x in zip(sides, (at_a, at_b)))
            for out, x in zip(ids, (at_a, at_b)):
                out.append(np.array(x if good else [], np.int64))
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in ids)
        self.a, self.b = (np.concatenate([*side, np.zeros(0, np.int64)]) for side in ids)
        self.a_doc, self.b_doc = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        # both sides hold the same bytes of every document, so running sums of lengths are places on one line
        a_ends, b_ends = (np.cumsum(s.lengths[x]) for s, x in zip(sides, (self.a, self.b)))
        a_starts, b_starts = (e - s.lengths[x] for s, x, e in zip(sides, (self.a, self.b), (a_ends, b_ends)))
        self.a_spans, self.b_spans = (a_starts, a_ends), (b_starts, b_ends)
        self.i, self.j = overlaps(a_starts, b_starts) if len(self.a) else (np.zeros(0, np.int64),) * 2
        self.same = a_ends[self.i] == b_ends[self.j]
        cut_a, cut_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        cut_a[self.i[self.same]] = cut_b[self.j[self.same]] = 1
        self.group_a, self.group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        self.n_groups = np.bincount(self.a_doc[cut_a == 1], minlength=len(texts))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``a id * 2**32 + b id`` of the links in order, and the number of them in each document."""
        i, j = self.i[self.same], self.j[self.same]
        return self.a[i] * PAIR + self.b[j], np.bincount(self.a_doc[i], minlength=len(self.n_a))

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document: the ids of both sides, group by group."""
        n = int(self.n_groups.sum())
        # side A of a group stands behind side B of the groups before, side B behind side A of its own group
        at_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, np.arange(n))[self.group_a]
        at_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, np.arange(n), "right")[self.group_b]
        shown = np.empty(len(self.a) + len(self.b), np.int64)
        for at, ids, group, after in ((at_a, self.a, self.group_a, 1), (at_b, self.b, self.group_b, 2)):
            last = np.append(group[1:] != group[:-1], True)[: len(group)]
            shown[at] = 3 * ids + np.where(last, after, 0)
        pieces = list(map(self._shown.__getitem__, shown.tolist()))
        ends = np.cumsum(self.n_a + self.n_b)
        return [b"".join(pieces[lo:hi])[:-1] for lo, hi in zip(ends - self.n_a - self.n_b, ends)]


def _batches(batch: pa.RecordBatch, limit: int = BATCH):
    """Runs of rows with about ``limit`` characters of text each; a longer text is a run of its own."""
    sizes = [len(t) if t is not None else 0 for t in batch.column(1).to_pylist()]
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def groups(docs: DataFrame, sides: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, nth, a_ids, b_ids, start, end`` per group of every document: its ids on both sides and its bytes.

    Offsets count the bytes of blank and text together. ``sides`` is as for ``align``.
    """

    def run(batches):
        pair = _sides(sides)
        for batch in (y for x in batches for y in _batches(x)):
            got = Aligned(pair, batch.column(1).to_pylist())
            if not len(got.a):
                continue
            first_a, first_b = (np.flatnonzero(np.append(True, g[1:] != g[:-1])) for g in (got.group_a, got.group_b))
            doc = got.a_doc[first_a]
            start, end = got.a_spans[0][first_a], got.a_spans[1][np.append(first_a[1:], len(got.a)) - 1]
            head = np.searchsorted(doc, np.arange(len(batch)))  # each document's first group
            base = start[head[doc]]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(f, len(x)), pa.int32()), pa.array(x, pa.int64())) for f, x in ((first_a, got.a), (first_b, got.b))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(np.arange(len(doc)) - head[doc]), *lists, pa.array(start - base), pa.array(end - base)],
                names=["id", "nth", "a_ids", "b_ids", "start", "end"],
            )

    kind = docs.select(id_col).schema[0].dataType
    given = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    out = given.mapInArrow(run, row_schema(kind, "nth bigint, a_ids array<bigint>, b_ids array<bigint>, start bigint, end bigint"))
    return out.withColumnRenamed("id", id_col)


def _written(docs: DataFrame, sides: tuple[str, str, str], id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds, written: documents with their links, and each slice's id pairs with their numbers of links."""

    def run(batches):
        pair, zip_ = _sides(sides), zstandard.ZstdCompressor(level=1)
        task, nth, held, counted = TaskContext.get().partitionId(), 0, 0, []
        names = ["id", "slice", "n_a", "n_b", "n_groups", "n_links", "digest", "links", "pairs", "counts"]

        def pairs_row():
            codes, inverse = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([n for _, n in counted]), len(codes)).astype(np.int64)
            one = [pa.array([slice_no()]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (codes, counts)]
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind), *one, *lists], names=names)

        def slice_no():
            return task * (1 << 32) + nth

        for batch in (z for x in batches for y in slices([x]) for z in _batches(y)):
            kind = batch.schema.field(0).type
            got = Aligned(pair, batch.column(1).to_pylist())
            codes, n = got.links()
            at = np.cumsum(n)
            blobs = [zip_.compress(codes[hi - k : hi].tobytes()) for hi, k in zip(at, n)]
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in got.group_texts()]
            cols = [pa.array(np.full(len(batch), slice_no())), *(pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_groups, n)), pa.array(digests), pa.array(blobs, pa.binary())]
            empty = [pa.nulls(len(batch), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *empty], names=names)
            if len(codes):
                counted.append(np.unique(codes, return_counts=True))
            held += len(codes)
            if held >= SLICE:
                yield pairs_row()
                nth, held, counted = nth + 1, 0, []
        if counted:
            yield pairs_row()

    spec = "slice bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, links binary, pairs array<bigint>, counts array<bigint>"
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    path = work_path(docs.sparkSession, "alignment")
    given.mapInArrow(run, row_schema(given.schema["id"].dataType, spec)).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, n, best`` out of ``pair, n``: links of each id pair over all rows, and whether its B id has none with more."""
    sums = durable(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    most = sums.groupBy(F.col("pair").bitwiseAND(F.lit(PAIR - 1)).alias("b")).agg(F.max("n").alias("most"))
    keyed = sums.withColumn("b", F.col("pair").bitwiseAND(F.lit(PAIR - 1)))
    return keyed.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, sides: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    ``sides`` names the byte-level BPE file, its pattern and the sentencepiece model. Texts that are null or empty, or
    whose joined token bytes on either side differ from a blank and the text, have no tokens: zeros and an empty digest.
    A link's count is the number of links of its id pair over all rows; ``n_best`` counts links whose pair is the most
    frequent of its B id, ties included. Rows with equal or null ids stay rows. A task holds one text, or some that have
    ``BATCH`` characters together, with their tokens; the counts come to the documents by slice of at most about
    ``SLICE`` links (a longer text is more), so no table of all pairs is ever held by one task. Other columns are not read.
    """
    stored = _written(docs, sides, id_col, text_col)
    held = stored.filter("pairs is not null").select("slice", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    own = held.select("slice", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = pair_counts(own.select("pair", "n"))
    looked = own.select("slice", "pair").join(dealt_anew(totals, "pair"), "pair")
    kind = stored.schema["id"].dataType
    table = looked.select("slice", F.lit(0).alias("kind"), "pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    texts = stored.filter("pairs is null").select("id", "slice", F.lit(1).alias("kind"), "n_a", "n_b", "n_groups", "n_links", "digest", "links")
    both = texts.unionByName(table, allowMissingColumns=True)

    def run(batches):
        unzip, at, known, codes, values = zstandard.ZstdDecompressor(), None, [], None, None
        for batch in batches:
            is_text, cut = batch["kind"].to_numpy(), batch["slice"].to_numpy()
            edges = np.flatnonzero((is_text[1:] != is_text[:-1]) | (cut[1:] != cut[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if not len(part):
                    continue
                if cut[lo] != at:
                    at, known, codes = cut[lo], [], None
                if not is_text[lo]:
                    known.append((part["pair"].to_numpy(), part["n"].to_numpy()))
                    continue
                if codes is None:
                    codes, values = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*known) if known else ((), ())))
                    known = []
                best, total = [], []
                for blob in part["links"]:
                    mine = np.frombuffer(unzip.decompress(blob.as_py()), np.int64)
                    n = values[np.searchsorted(codes, mine)] if len(mine) else np.zeros(0, np.int64)
                    best.append(int((n < 0).sum()))
                    total.append(int(np.abs(n).sum()))
                cols = [part[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(best, pa.int64()), pa.array(total, pa.int64()), part["digest"]], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    dealt = both.repartition("slice").sortWithinPartitions("slice", "kind", "pair")
    out = dealt.mapInArrow(run, row_schema(kind, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"))
    return out.withColumnRenamed("id", id_col)
