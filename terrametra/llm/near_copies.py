"""Which of many texts stay when near copies go.

Two texts are near copies if their five-word shingles have a Jaccard similarity of 0.8 or more. In the order of ``u`` (id,
then text) a text goes if it is a near copy of one that stays. Candidates share a SimHash fingerprint, linked fingerprints or
a band of MinHash values; parity sketches then leave out pairs whose sets must differ too much, before a shingle moves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.llm import set_join, shingles, simhash
from terrametra.llm.components import dealt_anew
from terrametra.llm.words import row_schema, slices
from terrametra.session import durable, free, written

SHINGLE = 5
PERCENT = 80
# A pair of similarity 0.8 agrees on none of 42 bands of 6 with a chance of 3 in a million, one of 0.4 meets in one of six.
BANDS = {"bands": 42, "rows": 6, "seed": 11}
TILE = 1024


def sketches(rows: DataFrame) -> DataFrame:
    """``u, n, band, own, low, keys`` per row of ``u, text``: shingles, parity sketches and one key per MinHash band."""

    def run(batches):
        at, none = set_join.bands(PERCENT), np.zeros(0, np.int64)
        kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]
        for batch in slices(batches, 128):
            out = []
            for text in batch.column(1):
                found = shingles.hashes(text.as_py(), SHINGLE)
                band = at.of(len(found))
                own, low = (set_join.sketch(found, at.scheme(b)[0]) if b >= 0 else none for b in (band, band - 1))
                out.append((len(found), band, own, low, shingles.band_keys(found, **BANDS)))
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["id", "n", "band", "own", "low", "keys"])

    spec = "n int, band int, own array<bigint>, low array<bigint>, keys array<bigint>"
    return rows.select("u", "text").mapInArrow(run, row_schema(rows.schema["u"].dataType, spec)).withColumnRenamed("id", "u")


def _shared(members: DataFrame) -> DataFrame:
    """``key, a, b``: the members of buckets of two texts or more; buckets come sorted, and none is held whole."""

    def run(batches):
        held, large = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], None

        def rows(part):
            key = part[0]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            keep = np.repeat((size > 1) | (key[first] == large if large is not None else False), size)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in part], names=["key", "a", "b"])

        for batch in batches:
            held = [np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield rows([c[:cut] for c in held])
                held = [c[cut:] for c in held]
            if len(held[0]) > set_join.HELD:  # what follows of this bucket is kept too
                yield rows(held)
                large, held = held[0][0], [c[:0] for c in held]
        if len(held[0]):
            yield rows(held)

    return members.distinct().repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, a bigint, b int")


def _buckets(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, a, b, u, n``: buckets of at least two texts that may be near copies, with u the text's first ``id, a, b``."""
    banded = texts.select(F.explode("keys").alias("key"), "a", "b")
    fps = durable(simhash.fingerprints(rows, "u", "text"))
    alike = fps.groupBy("fp").agg(F.min("u").alias("u"))
    members = fps.select(F.xxhash64("fp").alias("key"), F.col("u.a").alias("a"), F.col("u.b").alias("b"))
    linked = simhash.links(fps.select("fp").distinct(), 2, 4, 2).distinct()
    ends = linked.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    ends = ends.join(dealt_anew(alike, "fp"), "fp").select("key", F.col("u.a").alias("a"), F.col("u.b").alias("b"))
    met = _shared(banded.union(members).union(ends))
    return met.join(dealt_anew(texts.select("a", "b", "u", "n"), "a"), ["a", "b"]).select("key", "a", "b", "u", "n")


def may_be_near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; fa, fb) whose sizes and sketches allow the similarity, once each."""
    sized = ["n", "band", "own", "low"]
    mine = texts.select("a", "b", *sized)
    theirs = texts.select(*[F.col(c).alias(f"f{c}") for c in ("a", "b", *sized)])
    asked = pairs.select("a", "b", "fa", "fb").distinct()
    both = asked.join(dealt_anew(mine, "a"), ["a", "b"]).join(dealt_anew(theirs, "fa"), ["fa", "fb"])
    both = both.filter(100 * F.least("n", "fn") >= PERCENT * F.greatest("n", "fn"))  # so the bands are one or neighbours
    left = F.when(F.col("band") <= F.col("fband"), F.col("own")).otherwise(F.col("low"))
    right = F.when(F.col("fband") <= F.col("band"), F.col("fown")).otherwise(F.col("flow"))
    apart = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.filter(apart * (100 + PERCENT) <= (100 - PERCENT) * (F.col("n") + F.col("fn"))).select("a", "b", "fa", "fb")


def near(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; fa, fb) that are near copies by their shingles."""
    mine = may_be_near(pairs, texts).join(dealt_anew(sets, "a"), ["a", "b"])
    theirs = sets.select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("s").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    alike = 100 * both >= PERCENT * (F.size("s") + F.size("t") - both)
    return mine.join(dealt_anew(theirs, "fa"), ["fa", "fb"]).filter(alike).select("a", "b", "fa", "fb")


def _tiled(buckets: DataFrame, texts: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b, fa, fb``: pairs of a bucket, the later text first, whose sizes and sketches allow the similarity.

    Every two tiles of about ``tile`` texts meet in a task, which compares them by whole sketches; only pairs that pass
    leave it.
    """
    rows = buckets.select("key", "a", "b", "u").join(dealt_anew(texts.select("a", "b", "n", "band", "own", "low"), "a"), ["a", "b"])
    sizes = buckets.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = rows.join(dealt_anew(sizes, "key"), "key").withColumn("mine", F.pmod(F.xxhash64("a", "b"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    order = ["key", "x", "y"]

    def compare(t: pa.Table) -> np.ndarray:
        a, b, n, band, mine = (t[c].to_numpy() for c in ("a", "b", "n", "band", "mine"))
        own, low = (t[c].combine_chunks() for c in ("own", "low"))
        cross, found = t["x"][0].as_py() != t["y"][0].as_py(), [np.zeros((0, 2), np.int64)]
        for k in np.unique(band):
            here = np.flatnonzero((band == k) | (band == k + 1))  # the next band's sketches of this one
            bits = np.array([(own if band[i] == k else low)[i].values.to_numpy() for i in here]).view(np.uint64)
            for p in np.flatnonzero(band[here] == k):
                i = here[p]
                good = ((band[here] > k) | (np.arange(len(here)) > p)) & ((mine[here] != mine[i]) | (not cross))
                good &= 100 * np.minimum(n[here], n[i]) >= PERCENT * np.maximum(n[here], n[i])
                at = np.flatnonzero(good)
                apart = np.bitwise_count(bits[at] ^ bits[p]).sum(1, dtype=np.int64)
                at = here[at[apart * (100 + PERCENT) <= (100 - PERCENT) * (n[here[at]] + n[i])]]
                found.append(np.column_stack([np.maximum(i, at), np.minimum(i, at)]))
        found = np.concatenate(found)  # rows come in the order of u
        return np.column_stack([a[found[:, 0]], b[found[:, 0]], a[found[:, 1]], b[found[:, 1]]])

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            key, x, y = (held[k].to_numpy() for k in order)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *cuts], cuts):
                if hi - lo > 1:
                    yield out(compare(held.slice(lo, hi - lo)))
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and held.num_rows > 1:
            yield out(compare(held))

    def out(found: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found.T, kinds)], names=["a", "b", "fa", "fb"])

    dealt = placed.repartition(*order).sortWithinPartitions(*order, "u")
    return dealt.select(*order, "a", "b", "n", "band", "own", "low", "mine").mapInArrow(run, "a bigint, b int, fa bigint, fb int").distinct()


def _step(buckets: DataFrame, check) -> tuple[DataFrame, DataFrame]:
    """The texts that are the first of all their buckets, and what ``check`` leaves of the others they share one with."""
    firsts = buckets.groupBy("key").agg(F.min("u").alias("first"))
    led = buckets.join(dealt_anew(firsts, "key"), "key")
    stay = durable(led.groupBy("a", "b").agg(F.min("first").alias("first"), F.min("u").alias("u")).filter("first = u").select("a", "b", "u"))
    lead = buckets.join(dealt_anew(stay.select("a", "b"), "a"), ["a", "b"]).select("key", *[F.col(x).alias(f"f{x}") for x in buckets.columns if x != "key"])
    return stay, check(buckets.join(dealt_anew(lead, "key"), "key").filter("fu < u"))


def _left(buckets: DataFrame, done: DataFrame) -> DataFrame:
    """The buckets without the texts ``done``, where two or more are left."""
    rest = buckets.join(dealt_anew(done, "a"), ["a", "b"], "left_anti")
    sizes = rest.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    return rest.join(dealt_anew(sizes, "key"), "key")


def gone(buckets: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of the texts that have a near copy with a smaller ``u`` that stays.

    A text that is the first of all its buckets stays, and its near copies among them go; what is left is asked again.
    Once that no longer halves the pairs that could be asked, the pairs left meet in tiles, and the same rule runs over
    those that are near.
    """
    spark, out, last, path = buckets.sparkSession, [], None, None
    while True:
        sizes = buckets.groupBy("key").agg(F.count("*").cast("double").alias("m"))
        pairs = sizes.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0
        if not pairs or (last is not None and pairs > last / 2):
            break
        last, before = pairs, path
        stay, found = _step(buckets, lambda met: durable(near(met, texts, sets)))
        out.append(found)
        buckets, path = written(_left(buckets, stay.select("a", "b").union(found.select("a", "b")).distinct()), "buckets")
        if before:
            free(spark, before)
    if pairs:
        found = durable(near(_tiled(buckets, texts), texts, sets))
        ends = buckets.select("a", "b", "u").distinct()
        one = found.select(F.xxhash64("a", "b", "fa", "fb").alias("key"), F.explode(F.expr("array(struct(a, b), struct(fa AS a, fb AS b))")).alias("e"))
        buckets, path = written(one.select("key", "e.*").join(dealt_anew(ends, "a"), ["a", "b"]), "buckets")
        while not buckets.isEmpty():
            before = path
            stay, found = _step(buckets, durable)
            out.append(found)
            buckets, path = written(_left(buckets, stay.select("a", "b").union(found.select("a", "b")).distinct()), "buckets")
            free(spark, before)
    return reduce(DataFrame.union, [x.select("a", "b") for x in out]).distinct() if out else buckets.select("a", "b")


def staying(docs: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """``a, b, id`` of the texts that stay (hashes of the text, and the smallest id that has it, null first).

    Null and empty texts are one text; all texts without words are near copies of one another. Repeated rows are one.
    """
    a, b = F.xxhash64(text).alias("a"), F.hash(text).alias("b")
    rows = docs.select(F.struct(id_col.alias("id"), a, b).alias("u"), text.alias("text"))
    parts = [F.any_value(c).alias(c) for c in ("n", "band", "own", "low", "keys")]
    texts, _ = written(sketches(rows).groupBy("u.a", "u.b").agg(F.min("u").alias("u"), *parts), "texts")
    buckets, path = written(_buckets(rows, texts), "buckets")
    asked = buckets.select("u").distinct()
    given = rows.join(dealt_struct(asked), F.col("u").eqNullSafe(F.col("v"))).select("u", "text")

    def shingled(batches):
        for batch in slices(batches, 128):
            found = [shingles.hashes(t.as_py(), SHINGLE).view("i8") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    sets = given.mapInArrow(shingled, row_schema(given.schema["u"].dataType, "s array<bigint>"))
    sets, of_sets = written(sets.select("id.a", "id.b", "s").dropDuplicates(["a", "b"]), "shingles")
    less = durable(gone(buckets, texts, sets))
    free(docs.sparkSession, path, of_sets)
    return texts.join(dealt_anew(less, "a"), ["a", "b"], "left_anti").select("a", "b", F.col("u.id").alias("id"))


def dealt_struct(asked: DataFrame) -> DataFrame:
    return asked.select(F.struct(F.col("u.id"), F.shiftright(F.col("u.a"), 0).alias("a"), F.col("u.b")).alias("v"))
