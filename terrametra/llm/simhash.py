"""SimHash fingerprints, and links between them by bit-sliced comparison.

Distinct fingerprints meet in buckets that agree on ``match`` of ``segments`` bit segments; by the pigeonhole principle
two fingerprints within ``radius`` agree on at least ``segments - radius`` of them, so no link is lost. A bucket is held
as vertical bit planes (bit i of plane b is bit b of fingerprint i). One probe updates all distances of the bucket at
once with carry-save counters and stops as soon as every row has passed the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrametra.llm.components import components, dealt_anew
from terrametra.llm.words import row_schema, slices, word_blocks
from terrametra.session import durable

# Rows of a bucket that one task compares; a larger bucket is cut into tiles, and pairs of tiles are compared.
TILE = 2048


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """Another hash of the same shingles; table 0 is the hash itself."""
    if table:
        h = (h ^ np.uint64(table * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


def fingerprint(text: str | None, words: int = 3, tables: int = 1) -> list[int]:
    """Unsigned 64-bit SimHash over ``words``-word shingles, A-Z lower-cased, one per table; zeros without words.

    A bit is 1 if set in over half of the shingles' XXH64 values (seed 42), repeats included; further tables hash these
    values again. Very long texts are read in blocks, so only one block's shingles are held.
    """
    total, ones, tail = 0, np.zeros((tables, 64), np.int64), []

    def add(hashes: list[int]) -> None:
        h = np.array(hashes, "<u8")
        for t in range(tables):
            bits = np.unpackbits(_mixed(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[t] += bits.sum(0, dtype=np.int64)

    for block in word_blocks((text or "").encode().lower()):
        ws = tail + block
        if hashes := [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(ws[i:] for i in range(words)))]:
            add(hashes)
            total += len(hashes)
        tail = ws[max(0, len(ws) - words + 1) :]
    if not total and tail:
        add([xxh64_intdigest(b" ".join(tail), 42)])
        total = 1
    return [int.from_bytes(np.packbits(2 * row > total, bitorder="little").tobytes(), "little") for row in ones]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tables: int = 1) -> DataFrame:
    """``<id_col>, fp, more`` per row: the fingerprint as a signed long, and those of further tables; null texts have zeros."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t.as_py(), words, tables) for t in batch.column(1)], np.uint64).view(np.int64).reshape(-1, tables)
            cols = [batch.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1:].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "fp", "more"])

    schema = row_schema(docs.select(id_col).schema[0].dataType, "fp bigint, more array<bigint>")
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masks(segments: int, match: int) -> list[int]:
    """Bit masks of every choice of ``match`` out of ``segments`` nearly equal segments of 64 bits."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, match)]


def bit_planes(fps: np.ndarray, bits: list[int]) -> list[int]:
    """Plane b as one integer: its bit i is bit b of ``fps[i]``."""
    table = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(table[:, b], bitorder="little").tobytes(), "little") for b in bits]


def within(planes: list[int], probe: list[bool], rows: int, radius: int) -> int:
    """Those of ``rows`` (a bit set) at most ``radius`` bits from the probe.

    Counters start at ``2**k - radius - 1``, so a carry out of the top plane means that the radius is passed.
    """
    k = (radius + 1).bit_length()
    start = (1 << k) - radius - 1
    counter = [rows if start >> i & 1 else 0 for i in range(k)]
    alive = rows
    for plane, bit in zip(planes, probe):
        carry = (plane ^ rows if bit else plane) & alive
        for i in range(k):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
            if not carry:
                break
        else:
            alive &= ~carry
            if not alive:
                break
    return alive


def spanning_links(fps: np.ndarray, bits: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``radius``: a search that probes each row once, against rows not yet reached."""
    planes, out = bit_planes(fps, bits), []
    probes = [[bool(int(f) >> b & 1) for b in bits] for f in fps]
    left = (1 << len(fps)) - 1
    while left:
        first = left & -left
        left ^= first
        queue = [first.bit_length() - 1]
        while queue and left:
            at = queue.pop()
            found = within(planes, probes[at], left, radius)
            left &= ~found
            while found:
                low = found & -found
                found ^= low
                j = low.bit_length() - 1
                out.append((at, j))
                queue.append(j)
    return out


def links(distinct: DataFrame, radius: int, segments: int, match: int, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that keep every component of the radius graph connected."""
    if segments - radius < match:
        raise ValueError("fingerprints within the radius must agree on `match` segments")
    choice = masks(segments, match)
    signed = [m - (1 << 64) if m >> 63 else m for m in choice]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(s)).alias("key")) for i, s in enumerate(signed)])).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    placed = (
        keyed.join(dealt_anew(sizes, "key"), ["m", "key"])
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("m", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    group = ["m", "key", "i", "j"]

    def run(batches):
        def flush(m, fps):
            bits = [b for b in range(64) if not choice[m] >> b & 1]
            return [(fps[i], fps[j]) for i, j in spanning_links(np.array(fps, np.int64).view(np.uint64), bits, radius)]

        at, held = None, []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            n, found = len(cols[0]), []
            if not n:
                continue
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, n]):
                key = tuple(int(c[lo]) for c in cols[:4])
                if key != at:
                    if len(held) > 1:
                        found += flush(at[0], held)
                    at, held = key, []
                held += cols[4][lo:hi].tolist()
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(held) > 1 and (found := flush(at[0], held)):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint")


def table_links(fps: DataFrame, table: int, radius: int, segments: int, match: int) -> DataFrame:
    """Links of a further table as ``a, b`` of the first: a fingerprint stands for the smallest ``fp`` that has it."""
    pairs = fps.select("fp", F.col("more")[table - 1].alias("o")).distinct()
    first = durable(pairs.groupBy("o").agg(F.min("fp").alias("own")))
    same = pairs.join(dealt_anew(first, "o"), "o").filter("fp <> own").select(F.col("fp").alias("a"), F.col("own").alias("b"))
    near = links(first.select(F.col("o").alias("fp")), radius, segments, match)
    one = first.select(F.col("o").alias("a"), F.col("own").alias("x"))
    two = first.select(F.col("o").alias("b"), F.col("own").alias("y"))
    return same.union(near.join(one, "a").join(two, "b").select("x", "y"))


def all_links(fps: DataFrame, radius: int, segments: int, match: int, tables: int = 1) -> DataFrame:
    """``a, b``: links between the fingerprints ``fp`` of ``fps`` by any of its tables."""
    edges = links(fps.select("fp").distinct(), radius, segments, match)
    for table in range(1, tables):
        edges = edges.union(table_links(fps, table, radius, segments, match))
    return edges


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 2,
    segments: int = 4,
    match: int = 2,
    tables: int = 1,
) -> DataFrame:
    """One row per input row: ``<id_col>, fp`` (signed long) and ``component_id``, the smallest id reachable.

    Fingerprints that differ in at most ``radius`` bits are linked, in any of ``tables`` tables with hashes of their own (more
    tables miss fewer near copies); a component is what links connect. Equal
    fingerprints are one node, so copies cost one row each and are never paired. Null and empty texts share
    fingerprint zero and are linked like any other. A null id stays a row and counts for no minimum; a component
    without any id has a null ``component_id``. Repeated rows stay repeated. Other columns are not read.
    """
    fps = durable(fingerprints(docs, id_col, text_col, words, tables))
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(all_links(fps, radius, segments, match, tables))
    near = durable(roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first"))
    least = near.groupBy("root").agg(F.min("first").alias("linked"))
    moved = near.join(dealt_anew(least, "root"), "root").select("fp", "linked")
    classes = nodes.join(moved, "fp", "left").select("fp", F.least("first", "linked").alias("component_id"))
    return fps.join(dealt_anew(classes, "fp"), "fp").select(id_col, "fp", "component_id")
