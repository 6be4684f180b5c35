"""Mixing of sources to target weights on a low-discrepancy schedule.

Slot ``k`` of ``2**m`` belongs to the source whose share of the cumulative targets holds ``k / 2**m``; it comes up at time
``bit_reverse(k)``, so the times of the slots are van der Corput points and every stretch of the schedule holds each
source close to its share. The documents of a source lie shuffled on a line of words that is cut into equal blocks (the
line may be passed twice); the n-th slot of a source takes its n-th block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.llm.components import dealt_anew
from terrametra.operators.ranking import ordered_positions
from terrametra.session import durable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
# Words of a block, about; the number of slots is the next power of two.
BLOCK = 1 << 16
SEED = 20
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (src, source, source_size; src numbers the sources from 0) with the column ``target``.

    Sources weigh ``weights`` in turn and share ``share`` of all words. A target stops at ``epochs`` times its source; what
    is above goes to the others by weight until none is above. Each round is one small aggregate.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(epochs)
    rows = sizes.withColumn("_w", w).withColumn("_cap", cap)
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        full = F.col("_w") * F.lit(rate) >= F.col("_cap")
        n, held, free = rows.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))
        ).first()
        if n == capped or not free:
            break
        rate, capped = max(rate, (total - held) / free), n
    return rows.withColumn("target", F.least(F.col("_w") * F.lit(rate), F.col("_cap"))).drop("_w", "_cap")


def schedule(sources: DataFrame, total: float, block: int = BLOCK) -> DataFrame:
    """``src, nth, slot`` for every slot: its time, and which of its source's slots it is.

    ``sources`` has src, before (targets of the sources before) and target. Every source with a target gets a slot.
    """
    m = max(1, (int(total) // block).bit_length())
    top, step = 1 << m, 1 << 12
    lo = F.ceil(F.col("before") / total * top).cast("long")
    hi = F.greatest(F.ceil((F.col("before") + F.col("target")) / total * top).cast("long"), lo + 1)
    runs = sources.filter("target > 0").select("src", lo.alias("lo"), F.least(hi, F.greatest(lo + 1, F.lit(top))).alias("hi"))
    pages = runs.select("src", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {step}L)")).alias("from"))
    slots = pages.select("src", F.explode(F.expr(f"sequence(from, least(hi, from + {step}) - 1)")).alias("k"))
    slot = F.conv(F.reverse(F.lpad(F.conv(F.col("k").cast("string"), 10, 2), m, "0")), 2, 10).cast("long")
    timed = slots.select("src", slot.alias("slot"))
    return ordered_positions(timed, ["slot"], keys=["src"]).select("src", F.col("position").alias("nth"), "slot")


def lines(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = SEED) -> DataFrame:
    """Every row on its source's line, shuffled: id, source, h (text hash), src, position, size, at (words before)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = durable(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = ordered_positions(sizes, [F.col("source").asc_nulls_last()])
    sizes = durable(ordered.select("source", "source_size", F.col("position").alias("src")))
    rows = rows.join(dealt_null_safe(sizes), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("mix", F.xxhash64(F.lit(seed), F.col("id"), F.col("h")))
    placed = ordered_positions(rows, ["mix", "id", "h"], keys=["src"], weight="size")
    return placed.withColumnRenamed("weight_before", "at").drop("mix", "group_rows"), sizes


def dealt_null_safe(sizes: DataFrame) -> DataFrame:
    """The table of sources, ready for a null-safe join by name."""
    return sizes.select(F.col("source").alias("_s"), "src", "source_size")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    block: int = BLOCK,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The documents' rows, and the pieces of the mix.

    Rows: ``src, position`` (together unique), ``id, source, h, size, source_size, target``. Pieces: ``slot`` (time),
    ``src, position`` of the row, ``start, words`` of the piece within it. In slot order the pieces are the mix; a piece
    is at most one block long, and a row has at most ``epochs`` times its words in all. Words are counted over whole
    texts; null texts have none and enter no slot. A null source is a source of its own and comes last; ids may be null
    or repeated, equal rows are told apart by position. The order of a line is a hash of id and text, so reruns agree.
    """
    rows, sizes = lines(docs, id_col, text_col, source_col, seed)
    wanted = durable(targets(sizes, weights, share, epochs))
    total = wanted.agg(F.sum("target")).first()[0] or 0.0
    rows = durable(rows.join(F.broadcast(wanted.select("src", "target")) if wanted.count() < 10_000 else wanted.select("src", "target"), "src"))
    if not total:
        none = rows.sparkSession.createDataFrame([], "slot long, src long, position long, start long, words long")
        return rows, none
    before = ordered_positions(wanted.withColumn("_all", F.lit(0)), ["src"], keys=["_all"], weight="target")
    plan = durable(before.select("src", F.col("weight_before").alias("before"), "target", "source_size"))
    slots = durable(schedule(plan, total, block))
    counts = slots.groupBy("src").agg(F.max("nth").alias("n"))
    sized = plan.join(counts, "src").select("src", F.floor("target").alias("words"), "source_size", (F.col("n") + 1).alias("n"))
    sized = sized.withColumn("each", F.greatest(F.ceil(F.col("words") / F.col("n")), F.lit(1)).cast("long"))
    laid = rows.filter("size > 0").select("src", "position", "at", "size").join(dealt_anew(sized.drop("n"), "src"), "src")
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    laid = laid.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("at"))
    laid = laid.withColumn("to", F.least(F.col("from") + F.col("size"), "words")).filter("to > from")
    laid = laid.withColumn("nth", F.explode(F.expr("sequence(from div each, (to - 1) div each)")))
    a, b = F.greatest("from", F.col("nth") * F.col("each")), F.least("to", (F.col("nth") + 1) * F.col("each"))
    pieces = laid.select("src", "nth", "position", (a - F.col("from")).alias("start"), (b - a).alias("words"))
    return rows, pieces.join(slots, ["src", "nth"]).select("slot", "src", "position", "start", "words")


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``taken``, the words that the mix takes from each, and ``first_slot``, when it first does (else null)."""
    sums = pieces.groupBy("src", "position").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return rows.join(dealt_anew(sums, "position"), ["src", "position"], "left").fillna(0, ["taken"])
