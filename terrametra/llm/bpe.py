"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where they agree, then encoded piece by piece.

The pattern looks ahead but never back, so the matches from a boundary on depend only on the text behind it. A chunk
starts ``OVERLAP`` characters early, and by its own first character the matches have nearly always fallen in step with
those of the chunk before. Whether they did is checked for every seam: the last match of a chunk must end where the
first match of the next one starts. Chunks whose seam does not agree are joined and matched again.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.llm.words import row_schema, slices

CHUNK = 1 << 16
OVERLAP = 256
# Characters behind a chunk's end that matches may look at; a match that reaches the end of them is not final.
AHEAD = 256
# Pieces whose ids a worker remembers.
MEMO = 1 << 16
_FILES: dict = {}


class Codec:
    """Pre-tokeniser, encoder and decoder over a file of ranks; no special tokens."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.find = regex.compile(pattern).findall
        self.tokens = {r: t for t, r in table.items()}
        self.ids: dict[str, list[int]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        if (ids := self.ids.get(piece)) is None:
            if len(self.ids) >= MEMO:
                self.ids.clear()
            ids = self.encoding.encode_ordinary(piece)
            if len(piece) < 64:
                self.ids[piece] = ids
        return ids

    def encode_pieces(self, pieces: list[str]) -> np.ndarray:
        """The ids of pre-token matches, each encoded apart."""
        return np.fromiter(chain.from_iterable(map(self.encode_piece, pieces)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' raw bytes, joined; a cut character stays cut."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(ranks: str, pattern: str) -> Codec:
    """One codec per worker and file."""
    if ranks not in _FILES:
        _FILES[ranks] = Codec(ranks, pattern)
    return _FILES[ranks]


def chunk_pieces(find, text: str, start: int, begin: int, end: int, final: bool) -> tuple[list[str], int, int, bool]:
    """Matches of ``text`` (which begins at ``start`` of its document) that begin in ``[begin, end)``.

    Returns them with the place where the first begins, where the last ends, and whether they are sure: a match that
    touches the end of a text that goes on may have been longer.
    """
    pieces, at = find(text), start
    first, last, kept, size = -1, begin, [], start + len(text)
    for p in pieces:
        if at >= end:
            break
        if at >= begin:
            first = at if first < 0 else first
            kept.append(p)
            last = at + len(p)
        at += len(p)
    return kept, first if first >= 0 else at, last if kept else at, final or at < size


def pieces_of(find, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pre-token matches of a whole text from overlapping chunks, stitched; equal to one pass over the text."""
    if len(text) <= chunk:
        return find(text)
    out: list[str] = []
    at = 0  # a true boundary
    for begin in range(0, len(text), chunk):
        end = min(len(text), begin + chunk)
        if at >= end:
            continue
        start, stop = max(0, begin - overlap), min(len(text), end + AHEAD)
        got, first, last, sure = chunk_pieces(find, text[start:stop], start, at, end, stop == len(text))
        while first != at or not sure:  # out of step, or cut: match again from the boundary, looking further ahead
            stop = min(len(text), stop + chunk)
            got, first, last, sure = chunk_pieces(find, text[at:stop], at, at, end, stop == len(text))
        out += got
        at = last
    return out


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``<id_col>, ids`` per row: the ids as little-endian unsigned 32-bit integers.

    A text of at most ``chunk`` characters is encoded where it lies. A longer one is cut into chunks that are dealt out
    and encoded apart; equal long texts are encoded once. The seams are checked when the parts meet again, and a text
    with a seam that does not agree is stitched in one place instead. Null counts as empty and has no ids; null and
    repeated row ids stay as they are; other columns are not read.
    """
    schema = row_schema(docs.select(id_col).schema[0].dataType, "ids binary")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.when(F.length("text") > chunk, F.sha2("text", 256)))

    def whole(batches):
        code = codec(ranks, pattern)
        for batch in slices(batches):
            ids = [code.encode_pieces(pieces_of(code.find, t.as_py(), chunk, overlap)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    short = rows.filter("h IS NULL").select("id", "text").mapInArrow(whole, schema)

    def cut(batches):
        for batch in slices(batches):
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                out = []
                for begin in range(0, len(text), chunk):
                    end = min(len(text), begin + chunk)
                    start, stop = max(0, begin - overlap), min(len(text), end + AHEAD)
                    out.append((h, start, begin, end, stop == len(text), text[start:stop]))
                cols = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "start", "begin", "end", "final", "part"])

    def apart(batches):
        code = codec(ranks, pattern)
        for batch in slices(batches):
            out = []
            for h, start, begin, end, final, part in zip(*(c.to_pylist() for c in batch.columns)):
                got, first, last, sure = chunk_pieces(code.find, part, start, begin, end, final)
                out.append((h, begin, first, last if sure else -1, code.encode_pieces(got).tobytes()))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], names=["h", "begin", "first", "last", "ids"]
            )

    def joined(batches):
        code = codec(ranks, pattern)
        for batch in slices(batches):
            out = []
            for parts, text in zip(batch.column(1), batch.column(2)):
                parts = parts.as_py()
                seams = zip([{"last": 0}, *parts], parts)
                if all(a["last"] == b["first"] for a, b in seams) and parts[-1]["last"] >= 0:
                    out.append(b"".join(p["ids"] for p in parts))
                else:
                    out.append(code.encode_pieces(pieces_of(code.find, text.as_py(), chunk, overlap)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "ids"])

    texts = rows.filter("h IS NOT NULL")
    parts = (
        texts.groupBy("h").agg(F.first("text").alias("text"))
        .mapInArrow(cut, "h string, start bigint, begin bigint, end bigint, final boolean, part string")
        .repartition("h", "begin")
        .mapInArrow(apart, "h string, begin bigint, first bigint, last bigint, ids binary")
        .groupBy("h")
        .agg(F.array_sort(F.collect_list(F.struct("begin", "first", "last", "ids"))).alias("parts"))
        .withColumnRenamed("h", "g")
    )
    long = texts.join(parts, F.col("h") == F.col("g")).select("id", "parts", "text").mapInArrow(joined, schema)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", raw: bool = True) -> DataFrame:
    """``<id_col>, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode`'s rows, and ``decoded``, the raw bytes, with ``raw``."""
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", decoded binary" * raw
    schema = row_schema(encoded.select(id_col).schema[0].dataType, fields)

    def run(batches):
        code = codec(ranks, pattern)
        for batch in slices(batches):
            out = []
            for ids in batch.column(1):
                ids = ids.as_py()
                text = code.decode(np.frombuffer(ids, "<u4"))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), text)[: 3 + raw])
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()][: 3 + raw]
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return encoded.select(id_col, "ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)
