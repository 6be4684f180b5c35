"""A training corpus from raw documents: language, near copies, repeated passages, source mix, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet and reads it
again as the next stage's input. All stages but the last return the columns they were given. Rows are told apart by id
and content, so null and repeated ids, null texts and extra columns of any name pass through; an empty table gives an
empty one. ``doc_id, text, lang`` and ``source`` are read; a column ``n_chars`` follows the text where it changes.
"""

from __future__ import annotations

from functools import reduce

from public_tokenizers import PATTERN, path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametra.llm import bpe, language, mixing, near_copies, substring
from terrametra.llm.components import dealt_anew
from terrametra.llm.words import small_batches
from terrametra.session import durable, work_path


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _rest(docs: DataFrame) -> Column:
    """All columns but the text as one struct; a struct keeps names from clashing with working columns."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")


def _as_given(rows: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """Columns ``rest`` and ``text`` as the columns of ``docs``."""
    out = {c: F.col("text") if c == "text" else F.col("rest").getField(c) for c in docs.columns}
    if changed and "n_chars" in out:
        out["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(k) for k, v in out.items()])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; texts without a letter and ambiguous ones go.

    The classifiers learn from the rows of this stage that have a label. Without any label there is nothing to tell
    apart, and all documents stay.
    """
    small_batches(spark)
    model = language.fit(docs.filter(language.fold() != 2), "text", "lang", "doc_id")
    if not model.languages:
        return docs
    rows = docs.select(F.struct(_rest(docs), F.col("text")).alias("row"), _text().alias("text"))
    found = language.identify(rows, model, "row")
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return _as_given(kept.select("row.*"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies of documents that stay; the one with the smallest id stays, null ids first.

    Two texts are near copies if their five-word shingles have a Jaccard similarity of at least 0.8. In the order of their
    ids, a text goes if it is a near copy of one that stays, so no two near copies stay, and what goes has its near copy
    among what stays. Candidates come from SimHash fingerprints and MinHash bands (``llm.near_copies``). Of equal texts the
    row with the smallest id stays; of rows that share text and id, the first by their other columns as JSON.
    """
    small_batches(spark)
    kept = near_copies.staying(docs, F.col("doc_id"), _text())
    rows = docs.select(F.xxhash64(_text()).alias("a"), F.hash(_text()).alias("b"), _rest(docs), F.col("doc_id"), F.col("text"))
    # a null-safe comparison that is no join key, so that rows are dealt by text alone
    same = F.coalesce(F.col("doc_id") == F.col("id"), F.col("doc_id").isNull() & F.col("id").isNull())
    met = rows.join(dealt_anew(kept, "a"), ["a", "b"]).filter(same)
    one = met.groupBy("a", "b").agg(F.min_by(F.struct("rest", "text"), F.struct(F.to_json("rest"), "text")).alias("r"))
    return _as_given(one.select("r.rest", "r.text"), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its words in repeated passages; a text that loses none is unchanged, null stays null."""
    small_batches(spark)
    rows = docs.select(F.struct(_rest(docs), F.col("text").isNull().alias("null")).alias("row"), _text().alias("text"))
    found = substring.without_repeats(rows, "row", as_is=True)
    text = F.when(~F.col("row.null"), F.col("kept")).alias("text")
    return _as_given(found.select("row.rest", text), docs, changed=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken over the words held, rounded, so up to twice.

    Equal rows share what is taken from them evenly; a document of which less than half is taken, or without words,
    is not in the mix.
    """
    laid, pieces = mixing.mix(docs)
    taken = mixing.taken(laid, pieces).groupBy("id", "source", "h").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = taken.filter("size > 0").select(
        F.struct("id", "source").alias("i"), "h", F.round(F.col("taken") / F.col("size")).cast("int").alias("n")
    )
    rows = docs.select(
        _rest(docs), F.col("text"), F.xxhash64(_text()).alias("g"), F.struct(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source")).alias("j")
    )
    met = rows.join(times.filter("n > 0"), (F.col("g") == F.col("h")) & F.col("i").eqNullSafe(F.col("j")))
    return _as_given(met.withColumn("nth", F.explode(F.sequence(F.lit(1), "n"))).select("rest", "text"), docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256``: the ids of every text, and what they decode to.

    The ids are written before they are decoded, so that a task has one Python worker at a time and a lost executor
    costs no encoding.
    """
    small_batches(spark)
    ranks = path("byte_bpe_50k.tiktoken")
    coded = durable(bpe.encode(docs, ranks, PATTERN))
    out = bpe.decode(coded.select(F.struct("doc_id", "ids").alias("row"), "ids"), ranks, PATTERN, "row", raw=False)
    return out.select("row.doc_id", "row.ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_texts),
]

# SQL cannot fit the classifiers, hash shingles or merge bytes; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        folder = work_path(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(folder)
        return spark.read.parquet(folder)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
