"""Token ids as compact files: one zstandard frame per document, a shared dictionary and an offset index.

A folder holds ``dictionary`` (one row: ``sha256, data``) and ``blocks``, Parquet rows of up to ``BLOCK_DOCS`` consecutive
documents: ``shard, block`` (the order), ``dictionary`` (the hash needed to read it), ``ids, n_tokens, offsets`` (index)
and ``data`` (the frames, one behind the other). A frame holds little-endian unsigned 32-bit token ids. One document is
read by its block's row and one slice, without the other frames. Parquet is the container because executors write it to
whatever store the cluster has.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrametra.llm.words import slices
from terrametra.session import durable

BLOCK_DOCS = 256
BLOCK_BYTES = 4 << 20
END = 0
# The dictionary is trained on about this many documents (chosen by a hash of the id), at most twice as many, and on at
# most so many bytes of each.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 1 << 15
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
MEMO = 3 << 17
PART = 1 << 20
# New words that are encoded in one call, and those of them that are joined to one text.
TOGETHER = 1 << 14
JOINED = 64
_UNSAFE = re.compile(r" (?=\s|\Z)(?<=\s )")
_CUT = re.compile(r"\S (?=\S)")
_FILES: dict = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` with these starts and sizes, one behind the other."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


class Remembered:
    """Ids of strings by the strings' number; those of the first strings stay, one behind the other, with where each one's end."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def numbered(self, strings: np.ndarray, encode, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of remembered and of these strings, where each one's end, and the numbers of these strings.

        ``encode`` gives the ids of a list of strings, one behind the other, and how many each has. At most ``room``
        strings are remembered.
        """
        numbers = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(numbers < 0)
        if not len(new):
            return self.flat, self.ends, numbers
        fresh, had, found, sizes = strings[new].tolist(), len(self.ends), [self.flat], []
        for at in range(0, len(fresh), TOGETHER):
            ids, n = encode(fresh[at : at + TOGETHER])
            found.append(ids)
            sizes.append(n)
        flat, ends = np.concatenate(found), np.append(self.ends, len(self.flat) + np.cumsum(np.concatenate(sizes)))
        numbers[new] = np.arange(had, len(ends))
        if (left := room - had) > 0:
            self.known.update(zip(fresh[:left], range(had, room)))
            self.ends = ends[:room].copy()
            self.flat = flat[: self.ends[-1]].copy()
        return flat, ends, numbers


class Words(Remembered):
    """Encodes with a tokenizers file, each distinct word of some texts once, and remembers words.

    No match of the byte-level pattern holds a blank behind another character, and a blank before a visible character
    always starts one. So a text splits at its blanks into pieces that are encoded alike alone and in place, unless a
    blank has white space on both sides; such a text, or one with the string of an added token, is encoded as a whole.

    The blank and the letters that a piece begins with are one match, and the rest is encoded alike behind any letters.
    So a piece is cut there: words of letters are remembered once, whatever signs follow them. Joined by blanks they
    need the library's merges alone, without its pattern, since no merge leads from a letter to a blank. What else there
    is goes through the whole library, joined by blanks too, a rest behind the word ``a``. In both the tokens that begin
    with a blank are where words begin.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer(self.library.model)  # the merges alone; the model is shared
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        signs = _byte_letters()
        blank, tokens = chr(signs[32]), [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.begins = np.array([t.startswith(blank) for t in tokens])
        # A token with a blank behind something else is no danger if it holds white space that words of letters lack.
        white, later = {chr(signs[b]) for b in b"\t\n\v\f\r"}, re.compile(f"[^{blank}]{blank}")
        nbsp = "".join(chr(signs[b]) for b in "\xa0".encode())
        self.cutting = not any(later.search(t) and nbsp not in t and white.isdisjoint(t) for t in tokens)
        # Bytes by what they end: 0 a letter or a part of one, 1 something else, 2 what is not told here, 3 a pair that ``pairs`` tells.
        self.kinds = np.ones(256, np.uint8)
        self.kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0)]] = 0
        self.kinds[0xC0:0xE0], self.kinds[0xE0:] = 3, 2
        alone = self.library.pre_tokenizer.pre_tokenize_str
        self.pairs = np.array([c < 0x80 or len(alone("a" + chr(c))) > 1 for c in range(0x800)])
        self.lead = len(self._whole([" a"])[0])
        # Pieces that are not letters only, behind the word ``a`` instead of their own.
        self.rests = Remembered()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a blank, one behind the other, and how many each has."""
        texts = [" " + " ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(words):
            raise ValueError("a piece does not begin where its blank is")
        return ids, np.diff(np.append(cuts, len(ids)))

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(self.tokenizer, words)

    def _matched(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_merged``, of any pieces; those that begin or end with white space would match with their neighbours."""
        edged = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        inner = [w for w, e in zip(words, edged) if not e]
        ids, n = self._joined(self.library, inner) if inner else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if len(inner) == len(words):
            return ids, n
        joined, alone = iter(np.split(ids, np.cumsum(n)[:-1])), iter(self._whole([" " + w for w, e in zip(words, edged) if e]))
        parts = [next(alone if e else joined) for e in edged]
        return np.concatenate(parts), np.array(list(map(len, parts)))

    def _cuts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where the letters end that each piece begins with; its start if that is not told here."""
        starts, ends = offsets[:-1], offsets[1:]
        if not self.cutting:
            return starts
        kinds = self.kinds[data]
        two = np.flatnonzero(kinds == 3)
        kinds[two] = self.pairs[(data[two].astype(np.int64) & 31) << 6 | data[two + 1] & 63]
        stops = np.flatnonzero(kinds)
        first = np.append(stops, len(data))[np.searchsorted(stops, starts)]
        told = (first >= ends) | (np.append(kinds, 0)[first] == 1)
        return np.where(told, np.minimum(first, ends), starts)

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces behind a blank, one behind the other, and how many each has.

        The first ``MEMO`` words of letters are remembered, and of the rests half as many.
        """
        n = len(pieces)
        if not n:
            return self.flat[:0], self.ends[:0]
        _, offsets, data = pieces.buffers()
        data = data or pa.py_buffer(b"")
        offsets = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + n + 1]
        bounds = np.empty(2 * n + 1, np.int64)
        bounds[::2] = offsets
        bounds[1::2] = cuts = self._cuts(offsets, np.frombuffer(data, np.uint8)[: offsets[-1]])
        halves = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(bounds), data)
        led = cuts > offsets[:-1]
        more = ~led | (cuts < offsets[1:])
        starts, sizes = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)

        def put(at, memo, strings, encode, room, before):
            coded = strings.dictionary_encode()
            flat, ends, numbers = memo.numbered(coded.dictionary.to_numpy(zero_copy_only=False), encode, room)
            codes, n = numbers[coded.indices.to_numpy()], np.diff(ends, prepend=0)
            sizes[at], starts[at] = n[codes], before + (ends - n)[codes]
            return flat

        at = 2 * np.flatnonzero(led)
        flat = put(at, self, halves.take(pa.array(at)), self._merged, MEMO, 0)
        at, behind = 2 * np.flatnonzero(more) + 1, led[more]
        a, none = (pa.scalar(x, pa.large_string()) for x in ("a", ""))
        rests = pc.binary_join_element_wise(pc.if_else(pa.array(behind), a, none), halves.take(pa.array(at)), none)
        others = put(at, self.rests, rests, self._matched, MEMO // 2, len(flat))
        starts[at] += self.lead * behind
        sizes[at] -= self.lead * behind
        return _gathered(np.concatenate([flat, others]), starts, sizes), sizes[::2] + sizes[1::2]

    def _split(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of texts that may be split at their blanks."""
        lists = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        offsets, values = lists.offsets.to_numpy(), lists.flatten()
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True  # every text has a first piece, which has no blank in front
        later = values.filter(pa.array(~first)).dictionary_encode()
        flat, sizes = self._pieces(later.dictionary)
        heads = self._whole(values.take(pa.array(offsets[:-1])).to_pylist())
        codes = np.empty(len(values), np.int64)
        codes[first] = np.arange(len(sizes), len(sizes) + len(parts))
        codes[~first] = later.indices.to_numpy()
        flat, sizes = np.concatenate([flat, *heads]), np.append(sizes, list(map(len, heads)))
        n = sizes[codes]
        every = _gathered(flat, (np.cumsum(sizes) - sizes)[codes], n)
        return np.split(every, np.append(0, np.cumsum(n))[offsets[1:-1]])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as the library gives them."""
        parts, out = [], [[] for _ in texts]
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                special = any(s in text for s in self.added)
                if not special and end - at > PART and (cut := _CUT.search(text, at + PART)):
                    end = cut.start() + 1
                part = text[at:end]
                if special or _UNSAFE.search(part):
                    out[i] += self._whole([part])
                else:
                    parts.append(part)
                    out[i].append(len(parts) - 1)
                at = end
        split = self._split(parts) if parts else []
        none = np.zeros(0, "<u4")
        return [np.concatenate([none, *(split[x] if isinstance(x, int) else x for x in found)]) for found in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def words(path: str) -> Words:
    if path not in _FILES:
        _FILES[path] = Words(path)
    return _FILES[path]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; empty if they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end it with id 0 and write ``folder`` in ascending id order, null ids first.

    A null text has no ids but the end. Rows with equal ids are ordered by their ids' checksum and stay repeated. No
    rows write an empty folder that reads back empty. Only ``id_col`` and ``text_col`` are read.
    """
    import zstandard

    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < SAMPLE_DOCS).limit(2 * SAMPLE_DOCS)

    def sample(batches):
        code = words(tokenizer)
        for batch in slices(batches):
            out = [ids.tobytes()[:SAMPLE_BYTES] for ids in code.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    shared = train_dictionary([bytes(r.ids) for r in picked.mapInArrow(sample, "ids binary").collect() if r.ids])
    sha = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(sha, bytearray(shared))], "sha256 string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def frames(batches):
        code = words(tokenizer)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared), write_content_size=True)
        for batch in slices(batches):
            out = []
            for ids in code.encode_all(batch.column(1).to_pylist()):
                ids = np.append(ids, np.array([END], "<u4"))
                raw = ids.astype("<u4").tobytes()
                out.append((len(ids), zlib.crc32(raw), zip_.compress(raw)))
            cols = list(zip(*out)) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "n", "crc", "frame"]
            )

    def blocks(batches):
        names = ["shard", "block", "dictionary", "ids", "n_tokens", "offsets", "data"]
        held, size, block, shard = [], 0, 0, 0

        def row():
            ids, ns, fs = zip(*held)
            offsets = np.cumsum([0, *map(len, fs)])
            cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([sha]), pa.array([ids], pa.list_(id_type))]
            cols += [pa.array([ns], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([b"".join(fs)])]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, count, frame, part in zip(*(c.to_pylist() for c in batch.columns)):
                shard = part
                held.append((i, count, frame))
                size += len(frame)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield row()
                    held, size, block = [], 0, block + 1
        if held:
            yield row()

    encoded = durable(rows.mapInArrow(frames, f"id {kind}, n bigint, crc bigint, frame binary"))
    ordered = encoded.repartitionByRange("id", "crc").sortWithinPartitions("id", "crc")
    placed = ordered.select("id", "n", "frame", F.spark_partition_id().alias("shard"))
    spec = f"shard int, block bigint, dictionary string, ids array<{kind}>, n_tokens array<bigint>, offsets array<bigint>, data binary"
    placed.mapInArrow(blocks, spec).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``id, start, n_tokens, token_ids`` of every document; ``start`` counts the ids of all documents before it."""
    stored = spark.read.parquet(f"{folder}/blocks")
    known = {r.sha256: bytes(r.data) for r in spark.read.parquet(f"{folder}/dictionary").collect()}  # one row
    kind = stored.schema["ids"].dataType.elementType.simpleString()
    totals = stored.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("t"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("t").alias("t"))  # a row per written partition
    outer = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("shard", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("b"))
    inside = totals.select("shard", "block", F.coalesce(F.sum("t").over(inner), F.lit(0)).alias("a"))
    starts = inside.join(before, "shard").select("shard", "block", (F.col("a") + F.col("b")).alias("start"))

    def documents(batches):
        import zstandard

        readers = {sha: zstandard.ZstdDecompressor(dict_data=_dictionary(data)) for sha, data in known.items()}
        for batch in slices(batches, 4):
            for sha, ids, counts, offsets, data, start in zip(*(c.to_pylist() for c in batch.columns)):
                raw = [readers[sha].decompress(data[a:b]) for a, b in zip(offsets, offsets[1:])]
                if [len(r) // 4 for r in raw] != counts:
                    raise ValueError("the index does not fit its frames")
                at = start + np.cumsum([0, *counts[:-1]])
                cols = [pa.array(ids, batch.schema.field(1).type.value_type), pa.array(at), pa.array(counts), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "token_ids"])

    rows = stored.join(starts, ["shard", "block"]).select("dictionary", "ids", "n_tokens", "offsets", "data", "start")
    return rows.mapInArrow(documents, f"id {kind}, start bigint, n_tokens bigint, token_ids binary")
