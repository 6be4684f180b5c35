"""The registered queries over the test tables and their oracle SQL: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametra.llm import alignment, bpe, hard_negatives, html_text, language, license_scan, mixing, prefix_forest, set_join, simhash, substring, token_files, topk
from terrametra.llm.words import small_batches
from terrametra.session import work_path

RANKS = path("byte_bpe_50k.tiktoken")
TOKENIZER = path("byte_bpe_50k.json")
PIECES = path("piece_bpe_32k.model")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_read(spark, folder, "documents"))


def op3_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_forest.nearest(_read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    ids = bpe.encode(_read(spark, folder, "documents"), RANKS, PATTERN)
    return bpe.decode(ids, RANKS, PATTERN, raw=False)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = _read(spark, folder, "documents")
    model = language.fit(docs.filter(language.fold() != 2), "text", "lang", "doc_id")
    held_out = F.coalesce(language.fold() == 2, F.lit(False)).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    at = work_path(spark, "token-files")
    token_files.write(_read(spark, folder, "documents"), at, TOKENIZER)
    found = token_files.read(spark, at)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows, pieces = mixing.mix(_read(spark, folder, "documents"))
    out = mixing.taken(rows, pieces)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(_read(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(_read(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.without_repeats(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents whose four-word shingles have a Jaccard similarity of 0.85 or more."""
    return set_join.jaccard_groups(_read(spark, folder, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE tokens of every whole text against its sentencepiece tokens, with counts over all documents."""
    return alignment.align(_read(spark, folder, "documents"), (TOKENIZER, PATTERN, PIECES))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vector against all others; labels of every seventh vector are moved on by one."""
    rows = _read(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_license_scan,
        op3_prefix_forest,
        op4_byte_bpe,
        op5_language_id,
        op6_token_files,
        op7_mix_sources,
        op8_html_text,
        op9_simhash,
        op10_substring_dedup,
        op11_jaccard_join,
        op12_tokenizer_alignment,
        op13_hard_negatives,
        pipeline,
    )
}

ORACLES = {
    "op1_exact_top_k": """
WITH parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
whole AS (SELECT vec_id, i, floor(64 * x)::BIGINT AS w FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (
  SELECT doc_id, i, ws[i] AS word,
         CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS h FROM p),
c AS (SELECT doc_id, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS rep FROM s),
m AS (
  SELECT doc_id, i, word,
         bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
g AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
""",
    "op13_hard_negatives": """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
parts AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM rows_),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
whole AS (SELECT vec_id, label, i, floor(256 * x)::BIGINT AS w FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.w * c.w)::BIGINT AS score
  FROM whole a JOIN whole c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
}
