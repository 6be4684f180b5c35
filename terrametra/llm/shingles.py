"""Word shingles of a text as hashes, and MinHash keys over them."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

from terrametra.llm.words import word_blocks


def hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the text's ``words``-word shingles, A-Z lower-cased; of the whole sequence if it is shorter."""
    ws = [w for part in word_blocks((text or "").encode().lower()) for w in part]
    parts = zip(*(ws[i:] for i in range(words))) if len(ws) >= words else [ws]
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(p)) for p in parts), np.uint64))


def band_keys(found: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One signed key per band of ``rows`` MinHash values; sets of similarity j agree on a band with chance j ** rows."""
    seeds = np.random.default_rng(seed).integers(0, 1 << 63, (2, bands * rows), np.uint64)
    seeds[1] |= np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024, None] ^ seeds[0]) * seeds[1]).min(0))
    return np.array([xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)
