"""Jaccard join of word n-gram sets by parity sketches.

A set is hashed into sketches in which every element flips one bit. Two sketches differ at most where the sets differ, so
their Hamming distance is a lower bound of the symmetric difference, and a Jaccard threshold is an upper bound of it that
depends on the sizes alone. Sizes are cut into bands such that linked sets lie in one band or in two neighbouring ones. A
band has its bound D: its sketches are cut into more than D words, of which linked sets must share some (pigeonhole), so
sets meet by equal words; a word's key is the XOR of the hashes of its elements. Pairs that meet are compared by the whole
bit sketch, and what is left by the sets themselves.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrametra.llm.components import components, dealt_anew
from terrametra.llm.words import row_schema, slices, word_blocks
from terrametra.session import durable, free, written

# Bits of a sketch for each element of the smallest set of its band.
BITS = 2
# Sets that one task compares at a time; larger buckets are cut into tiles.
TILE = 2048
# A tile hands on all its pairs up to this many for each member, else the best ones of each member.
PAIRS = 4
BEST = 2
# Members that meet one leading set in a task.
LED = 512
# Rows of one bucket that are held before a part of it is handed on.
HELD = 1 << 16
OWN = np.int64(-(1 << 63))
# Words whose hashes a task remembers; the first ones it sees, among which the frequent ones are.
MEMO = 1 << 18
_ODD = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Bands:
    """Size bands of the threshold ``percent``: linked sets lie in one band or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1, 2]

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def most_different(self, both: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to ``both``."""
        return (100 - self.percent) * both // (100 + self.percent)

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            last = self.starts[-1]
            self.starts.append(max(last + 1, self.largest_partner(last - 1) + 1))
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def scheme(self, band: int) -> tuple[int, int, int]:
        """Bits of the band's sketches, their words, and how many words may be empty (none of these: bound 0).

        More than the bound of words differ from one another in no word that neither set touches: of ``words`` at least
        ``spare`` + 1 are equal, so one of them is not empty if one of the sets has no more than ``spare`` empty words.
        """
        self.of(self.starts[min(band, len(self.starts) - 1)])
        while len(self.starts) < band + 2:
            self.of(self.starts[-1])
        low, most = self.starts[band], self.starts[band + 1] - 1
        bound = self.most_different(most + self.largest_partner(most))
        spare = 1 + bound // 64
        return 64 * -(-BITS * low // 64), (bound + 1 + spare) if bound else 0, spare


@cache
def bands(percent: int) -> Bands:
    return Bands(percent)


def sketch(found: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the elements at each of ``bits`` places, as signed 64-bit words."""
    place = ((found * _MIX) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_xor.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def word_keys(found: np.ndarray, band: int, words: int, spare: int) -> np.ndarray:
    """Keys of the words of one band's sketch; empty words have one only if there are more than ``spare``."""
    if not words:
        return np.zeros(0, np.int64)
    h = found ^ (found >> np.uint64(31))
    word = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(words) >> np.uint64(32)).astype(np.int64)
    out, filled = np.zeros(words, np.uint64), np.zeros(words, bool)
    np.bitwise_xor.at(out, word, (found * _MIX) ^ (found >> np.uint64(29)))
    filled[word] = True
    place = (np.arange(words, dtype=np.uint64) + np.uint64(1 + (band << 40))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ place) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out[filled if words - filled.sum() <= spare else slice(None)].view(np.int64)


def set_code(found: np.ndarray) -> int:
    """63 bits that tell sets apart."""
    return xxh64_intdigest(found.tobytes(), 77) >> 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxh64_intdigest(word, 5)
        if len(self) < MEMO:
            self[word] = h
        return h


_HASHES = _WordHash()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the text's ``words``-word shingles, A-Z lower-cased; of the whole sequence if it is shorter.

    A shingle's hash is a polynomial in the 64-bit hashes of its words, mixed.
    """
    parts = [np.fromiter(map(_HASHES.__getitem__, block), np.uint64, len(block)) for block in word_blocks((text or "").encode().lower())]
    h = np.concatenate([*parts, np.zeros(0, np.uint64)])
    n = min(words, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(32))) * _ODD + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return np.unique(out ^ (out >> np.uint64(29)))


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.hash(text).alias("u")).alias("id"), text.alias("text"))


def sketches(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, n, c, band, own, low, keys, mine`` per row.

    The set's size and code, its band, its sketches of this band and of the one below, its word keys in both, and how
    many of these are of its own band. A task gives the keys of equal sets once, so copies cost a row per task and key.
    """

    def run(batches):
        at, seen, none = bands(percent), set(), np.zeros(0, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int32()]
        for batch in slices(batches, 128):
            rows = []
            for text in batch.column(1):
                found = shingle_hashes(text.as_py(), words)
                c, band = set_code(found), at.of(len(found)) if len(found) else -1
                own, low = (sketch(found, at.scheme(b)[0]) if b >= 0 else none for b in (band, band - 1))
                mine, other = (word_keys(found, b, *at.scheme(b)[1:]) if b >= 0 and c not in seen else none for b in (band, band - 1))
                seen.add(c)
                rows.append((len(found), c, band, own, low, np.concatenate([mine, other]), len(mine)))
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["id", "n", "c", "band", "own", "low", "keys", "mine"])

    spec = "n bigint, c bigint, band int, own array<bigint>, low array<bigint>, keys array<bigint>, mine int"
    return rows.mapInArrow(run, row_schema(rows.schema["id"].dataType, spec))


def keyed(stored: DataFrame) -> DataFrame:
    """``key, member``: every word key; a member is the set's code, negative where the key is of the set's own band."""
    member = F.when(F.col("at") < F.col("mine"), F.col("c").bitwiseOR(F.lit(int(OWN)))).otherwise(F.col("c"))
    return stored.select("c", "mine", F.posexplode("keys").alias("at", "key")).select("key", member.alias("member"))


def met(keys: DataFrame) -> DataFrame:
    """``key, a, b``: every member ``b`` of a bucket with its first one ``a`` of the bucket's band; key only for three or more.

    Buckets come sorted, so one is never held whole. A bucket without a set of its own band is passed over: its sets meet in
    their band.
    """

    def run(batches):
        held = np.zeros((0, 2), np.int64)
        lead = None  # the first member of a bucket that is handed on in parts

        def rows(part: np.ndarray):
            nonlocal lead
            if lead is not None and len(part) and part[0, 0] == lead[0]:
                part = np.concatenate([[lead], part])
            new = np.append(True, part[1:, 0] != part[:-1, 0])
            once = new | np.append(True, part[1:, 1] != part[:-1, 1])
            part, new = part[once], new[once]
            first = np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
            size = np.diff(np.append(np.flatnonzero(new), len(part)))[np.cumsum(new) - 1]
            good = ~new & (part[first, 1] < 0)
            part, at, size = part[good], part[first[good], 1], size[good]
            pairs = np.unique(np.column_stack([at[size == 2], part[size == 2, 1]]), axis=0)
            key = pa.array(np.append(part[size > 2, 0], np.zeros(len(pairs), np.int64)), mask=np.repeat([False, True], [(size > 2).sum(), len(pairs)]))
            a, b = np.append(at[size > 2], pairs[:, 0]), np.append(part[size > 2, 1], pairs[:, 1])
            return pa.RecordBatch.from_arrays([key, pa.array(a), pa.array(b)], names=["key", "a", "b"])

        for batch in batches:
            both = np.column_stack([c.to_numpy() for c in batch.columns])
            held = np.concatenate([held, both])
            if not len(held):
                continue
            cut = int(np.searchsorted(held[:, 0], held[-1, 0]))
            if cut:
                yield rows(held[:cut])
                held = held[cut:]
            if len(held) > HELD:  # the next part begins with the same lead; it counts as large
                first = held[0] if lead is None or lead[0] != held[0, 0] else lead
                yield rows(held)
                lead, held = first, held[-1:]
        if len(held):
            yield rows(held)

    return keys.repartition("key").sortWithinPartitions("key", "member").mapInArrow(run, "key bigint, a bigint, b bigint")


def _code(member: str) -> Column:
    return F.col(member).bitwiseAND(F.lit((1 << 63) - 1))


def may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (members a, b; a in its own band) whose sizes and sketches allow a link, as codes ``a, b``."""
    one = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("band").alias("ba"), F.col("own").alias("sa"))
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("band").alias("bb"), F.col("own").alias("sb"), "low")
    asked = pairs.select(_code("a").alias("a"), _code("b").alias("b")).filter("a <> b").distinct()
    rows = asked.join(dealt_anew(one, "a"), "a").join(dealt_anew(two, "b"), "b")
    rows = rows.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    theirs = F.when(F.col("bb") == F.col("ba"), F.col("sb")).otherwise(F.col("low"))
    apart = F.aggregate(F.zip_with("sa", theirs, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.filter(apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (codes a, b) whose sets are linked. Sets come from the texts of one row of each class.

    A set leads its pairs: it goes once to each run of ``LED`` members, and every member comes to it.
    """
    pairs = durable(pairs)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(dealt_anew(classes.select("c", "rep"), "c"), "c")
    given = rows.join(asked, F.col("id").eqNullSafe(F.col("rep"))).select("c", "text")

    def sets(batches):
        for batch in slices(batches):
            found = [np.sort(shingle_hashes(t.as_py(), words).view(np.int64)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["c", "s"])

    held = given.mapInArrow(sets, "c bigint, s array<bigint>").dropDuplicates(["c"])
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("int").alias("runs"))
    nth = F.pmod(F.xxhash64("b"), F.col("runs")).cast("int")
    members = pairs.join(dealt_anew(led, "a"), "a").select(F.col("b").alias("c"), "a", nth.alias("run"), F.lit(1).alias("kind"))
    leads = led.select(F.col("a").alias("c"), "a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("kind"))
    met = members.unionByName(leads).join(dealt_anew(held, "c"), "c").select("a", "run", "kind", "c", "s")

    def compare(batches):
        lead, at = None, None
        for batch in slices(batches):
            a, run, kind, c = (batch.column(i).to_numpy() for i in range(4))
            out = []
            for i, s in enumerate(batch.column(4)):
                mine = s.values.to_numpy()
                if not kind[i]:
                    lead, at = mine, (a[i], run[i])
                    continue
                if at != (a[i], run[i]):
                    raise ValueError("members without their lead")
                place = np.minimum(np.searchsorted(lead, mine), len(lead) - 1)
                both = int((lead[place] == mine).sum())
                if 100 * both >= percent * (len(lead) + len(mine) - both):
                    out.append((a[i], c[i]))
            x, y = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return met.repartition("a", "run").sortWithinPartitions("a", "run", "kind").mapInArrow(compare, "a bigint, b bigint")


def _open(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """``key, member, root``: the buckets whose members are not yet in one component."""
    roots = components(links)
    led = buckets.select("key", F.col("a").alias("member")).distinct()
    rows = led.unionByName(buckets.select("key", F.col("b").alias("member"))).withColumn("c", _code("member"))
    placed = rows.join(dealt_anew(roots.withColumnRenamed("node", "c"), "c"), "c", "left").select("key", "member", F.coalesce("root", "c").alias("root"))
    placed = durable(placed)
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    return placed.join(dealt_anew(mixed, "key"), "key")


def _across(opened: DataFrame, classes: DataFrame, percent: int, whole: bool = False, tile: int = TILE) -> DataFrame:
    """``a, b, more``: pairs of different components that meet in a bucket, one of them in its own band, and may link.

    A bucket is cut into tiles of about ``tile`` members and every two tiles meet, so no task holds a bucket. A tile with
    more than ``PAIRS`` pairs a member gives the ``BEST`` closest of each member and says that there are ``more``; with
    ``whole``, all.
    """
    sized = classes.select("c", "n", "own", "low")
    rows = opened.withColumn("c", _code("member")).join(dealt_anew(sized, "c"), "c")
    rows = rows.select("key", "member", "c", "root", "n", F.when(F.col("member") < 0, F.col("own")).otherwise(F.col("low")).alias("s"))
    sizes = opened.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = rows.join(dealt_anew(sizes, "key"), "key").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))

    order = ["key", "x", "y"]

    def compare(t: pa.Table) -> np.ndarray:
        member, c, root, n, mine = (t[x].to_numpy() for x in ("member", "c", "root", "n", "mine"))
        s = t["s"].combine_chunks()
        bits = s.flatten().to_numpy().reshape(len(s), -1).view(np.uint64)
        cross = t["x"][0].as_py() != t["y"][0].as_py()
        found, near = [np.zeros((0, 2), np.int64)], []
        for i in np.flatnonzero(member < 0):
            # two sets of the band meet once; those of the next band meet only sets of this one
            good = (root != root[i]) & ((member >= 0) | (c > c[i])) & ((mine != mine[i]) | (not cross))
            good &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            at = np.flatnonzero(good)
            apart = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            kept = apart * (100 + percent) <= (100 - percent) * (n[at] + n[i])
            found.append(np.column_stack([np.full(kept.sum(), i), at[kept]]))
            near.append(apart[kept] / (n[at[kept]] + n[i]))
        found, near = np.concatenate(found), np.concatenate([*near, np.zeros(0)])
        more = len(found) > PAIRS * len(c) and not whole
        if more:
            both = np.concatenate([found, found[:, ::-1]])  # each member's closest first
            order = np.lexsort((c[both[:, 1]], np.tile(near, 2), both[:, 0]))
            who = both[order, 0]
            found = both[order][np.arange(len(who)) - np.searchsorted(who, who) < BEST]
        i, j = c[found[:, 0]], c[found[:, 1]]
        return np.column_stack([np.minimum(i, j), np.maximum(i, j), np.full(len(found), more, np.int64)])

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            key, x, y = (held[k].to_numpy() for k in order)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            if len(cuts):
                found = [compare(held.slice(lo, hi - lo)) for lo, hi in zip([0, *cuts], cuts) if hi - lo > 1]
                yield batch_of(found)
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows > 1:
            yield batch_of([compare(held)])

    def batch_of(found) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=["a", "b", "more"])

    near = placed.select(*order, "member", "c", "root", "n", "s", "mine").repartition(*order).sortWithinPartitions(*order)
    return near.mapInArrow(run, "a bigint, b bigint, more boolean")


def _further(buckets: DataFrame, links: DataFrame, check, classes: DataFrame, percent: int) -> DataFrame:
    """``links`` and what else connects components of ``buckets``, until no pair that may link is left unchecked.

    ``check`` verifies pairs. Crowded tiles give their closest pairs first; those that are linked join components, so
    most other pairs need no check any more. Once no link is found that way, all pairs left are checked.
    """
    whole = False
    while True:
        opened = durable(_open(buckets, links))
        if opened.isEmpty():
            return links
        pairs = durable(_across(opened, classes, percent, whole))
        more = not pairs.filter("more").isEmpty()
        found = durable(check(pairs.select("a", "b").distinct()))
        whole = found.isEmpty()
        links = durable(links.union(found))
        if not more:
            return links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """``<id_col>, n_shingles, component_id`` per row: the size of its set and the smallest id that links reach.

    A row's set holds the distinct ``words``-word shingles of its whole text, A-Z lower-cased; with fewer words the whole
    sequence is one; null texts and texts without words have an empty set, linked with nothing. Sets are linked if 100
    times their intersection is at least ``percent`` times their union. Equal sets are one class, so copies are never
    paired. No link between different sets is missed: a pair that meets is left out only if its sets are in one component
    already, or if sizes or sketches rule a link out. Shingles and sets are told apart by 64-bit and 63-bit hashes. A
    null id stays a row and counts for no minimum; repeated rows stay repeated. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = _sets(docs, id_col, text_col)
    stored, _ = written(sketches(rows, words, percent), "sets")
    parts = [F.any_value(x).alias(x) for x in ("n", "band", "own", "low")]
    classes, _ = written(stored.filter("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.min("id.id").alias("first"), *parts), "classes")
    buckets, of_buckets = written(met(keyed(stored)), "buckets")

    def check(pairs: DataFrame) -> DataFrame:
        return verified(pairs, rows, classes, words, percent)

    links = durable(check(may_link(buckets.select("a", "b"), classes, percent)))
    links = _further(buckets.filter("key is not null"), links, check, classes, percent)
    free(spark, of_buckets)
    roots = components(links)
    near = durable(roots.join(dealt_anew(classes.select(F.col("c").alias("node"), "first"), "node"), "node"))
    least = near.groupBy("root").agg(F.min("first").alias("linked"))
    moved = near.join(dealt_anew(least, "root"), "root").select(F.col("node").alias("c"), "linked")
    found = classes.select("c", "first").join(dealt_anew(moved, "c"), "c", "left").select("c", F.least("first", "linked").alias("component_id"))
    # rows of one class may be very many: both sides are dealt out by exchanges of their own
    full = stored.filter("n > 0").join(dealt_anew(found, "c"), "c").select("id.id", "n", "component_id")
    alone = stored.filter("n = 0").select("id.id", "n", F.col("id.id").alias("component_id"))
    return full.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
