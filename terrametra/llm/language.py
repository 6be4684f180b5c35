"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. One linear classifier over hashed byte trigrams per bit tells the languages
with +1 from those with -1 (log odds of smoothed frequencies). A text's margins are compared with all codewords by an
exponential loss, so confident bits weigh more; the codeword of least loss wins, and a close second marks ambiguity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.llm.words import row_schema, slices

UNKNOWN = "und"
BINS = 1 << 14
# About this many labelled rows per language fit the classifiers, chosen by a hash of id and text.
SAMPLE = 1000
MAX_LANGUAGES = 4096
SMOOTHING = 0.5
SHARPNESS = 2.0
# A score below this is ambiguous.
AMBIGUOUS = 0.02
BLOCK = 1 << 20


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # BINS x bits


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords: every way to split the languages in two for up to 7, else the best of some random dense codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = [[1 if i == 0 or not b >> (i - 1) & 1 else -1 for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        code = rng.choice(np.array([1, -1], np.int8), (n, width))
        apart = (width - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        np.fill_diagonal(apart, width)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased whole text."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    out = np.zeros(BINS, np.int64)
    for at in range(0, len(data) - 2, BLOCK):
        b = data[at : at + BLOCK + 2].astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(18), minlength=BINS)
    return out


def fit(labelled: DataFrame, text_col: str, label_col: str, id_col: str, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows per label; rows with a null text, label or id are not learned from.

    No labelled row gives a model without languages. Rows are chosen by a hash, so copies of a row count together.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.col(id_col).alias("id")).dropna()
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r.label: r.n for r in counts.limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], codewords(0), np.zeros((BINS, 1)))
    spread = rows.join(F.broadcast(counts), "label")  # at most MAX_LANGUAGES rows
    picked = spread.filter(F.pmod(F.xxhash64("id", "text"), F.col("n")) < sample).select("label", "text")

    def tally(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[label] = sums.get(label, 0) + trigram_counts(text.as_py())
        for label, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(c[at])], names=["label", "bin", "c"])

    found = picked.mapInArrow(tally, "label string, bin bigint, c bigint").groupBy("label", "bin").agg(F.sum("c").alias("c"))
    table = np.zeros((len(languages), BINS))
    place = {name: i for i, name in enumerate(languages)}
    for label, at, c in found.toPandas().itertuples(index=False):  # at most BINS rows per language
        table[place[label], int(at)] = c
    share = (table + SMOOTHING) / (table.sum(1, keepdims=True) + SMOOTHING * BINS)
    code = codewords(len(languages))
    weights = np.zeros((BINS, code.shape[1]))
    for b in range(code.shape[1]):
        if (code[:, b] > 0).all() or (code[:, b] < 0).all():
            continue
        weights[:, b] = np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0))
    return Model(languages, code, weights)


def decide(model: Model, text: str | None, letter) -> tuple[str, float]:
    """Language and score in [0, 1]: one less the ratio of the two smallest losses; 1 with a single language."""
    if text is None or not model.languages or not letter(text):
        return UNKNOWN, 0.0
    if len(model.languages) == 1:
        return model.languages[0], 1.0
    counts = trigram_counts(text)
    margins = counts @ model.weights / counts.sum()
    loss = np.exp(-SHARPNESS * model.code * margins).sum(1)
    order = np.argsort(loss, kind="stable")
    return model.languages[order[0]], float(1 - loss[order[0]] / loss[order[1]])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, lang_pred, score, ambiguous`` per row, from the whole text alone.

    A text that is null or holds no letter is ``und`` with score 0 and not ambiguous; so is every text under a model
    without languages. Equal losses go to the language first in code-point order. Ids may be null or repeated.
    """
    schema = row_schema(docs.select(id_col).schema[0].dataType, "lang_pred string, score double, ambiguous boolean")

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        for batch in slices(batches):
            out = [decide(model, t.as_py(), letter) for t in batch.column(1)]
            langs, scores = zip(*out) if out else ((), ())
            doubt = [lang != UNKNOWN and s < AMBIGUOUS for lang, s in out]
            cols = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score", "ambiguous"])

    out = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id"):
    """Remainder by 4 of the CRC-32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
