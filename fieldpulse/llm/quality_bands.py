"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

Repetitive text compresses too well and random text too little.  How well
clean text compresses depends on its length, so each length class has its own
band of ratios (bytes / compressed bytes).  A document is kept when its whole
text lies in the band of its length, and no more than a share of its fixed
chunks lies outside the chunk band.  The last chunk is the last bytes of the
text, whether or not it overlaps the one before; a text shorter than a chunk is
one chunk with the band of its length.  Texts below the first length class carry
too little evidence and pass.

Plain rules stand beside the bands (``base_failed``): too few words, or too
many words in 8-word windows that occur again in the text.  Words are runs of
characters other than ASCII white space.

Defined results: a null text counts as empty (no words, base_failed); one row
out for one in, repeated rows and null ids included; columns other than the id
and text are neither read nor returned.  Whole texts are read; memory is
bounded by one Arrow batch slice (about 1 MB of text, or one longer text).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Bands:
    """(bytes from, lowest ratio, highest ratio) by length class, ascending; the chunk rules."""
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (256, 1.25, 3.5),          # base64 of random bytes reaches 1.20 in this class, 1.27 in the next
        (512, 1.35, 3.5),
        (1024, 1.45, 4.0),         # 1.34 from here on
        (8192, 1.6, 4.5),
        (65536, 1.6, 6.0),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.5, 4.5)
    bad_chunk_share: float = 0.5
    level: int = 1


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document, the words that lie in a window found twice or more in it."""
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    words = np.diff(first)
    size = len(hashes) - WINDOW + 1
    if size <= 0:
        return out
    doc = np.repeat(np.arange(n), words)
    at = np.flatnonzero(doc[:size] == doc[WINDOW - 1:])
    if not len(at):
        return out
    window, _ = T.shingles(hashes, np.array([0, len(hashes)]), WINDOW)
    key = T.mix64(window[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    hit = at[again]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _verdict(text: bytes, bands: Bands, compressor) -> tuple[float, float, bool]:
    """(ratio, share of chunks outside the chunk band, in the bands)."""
    if not text:
        return 0.0, 0.0, True
    ratio = len(text) / len(compressor.compress(text))
    low, high = next((lo, hi) for size, lo, hi in reversed(bands.whole) if len(text) >= size)
    inside, size = low <= ratio <= high, bands.chunk_bytes
    if len(text) < size:                                            # its only chunk, by the limits of its length
        return ratio, float(not inside), inside
    bad, n = 0, 0
    # whole chunks; a shorter rest is judged with the bytes before it, as the text's last ``size`` bytes
    for at in [*range(0, len(text) - size + 1, size), *([len(text) - size] if len(text) % size else [])]:
        r = size / len(compressor.compress(text[at:at + size]))
        n += 1
        bad += not bands.chunk[0] <= r <= bands.chunk[1]
    share = bad / n
    return ratio, share, inside and share <= bands.bad_chunk_share


def score(docs: DataFrame, bands: Bands = Bands(), min_words: int = 20, max_repeat_pct: int = 30,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, ratio, bad_chunks and kept."""
    def run(batches):
        import zstandard
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for part, data, offsets in T.doc_batches(batches):
            starts, ends, first = T.spans(data, offsets, ~T.SPACE)
            n_words = np.diff(first)
            code_points = np.concatenate([[0], np.cumsum(~T.SPACE[data] & ((data & 0xC0) != 0x80))])
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
            repeats = _repeats(T.word_hashes(data, starts, ends), first)
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            failed = (n_words < min_words) | (100 * repeats > max_repeat_pct * n_words)
            rated = [_verdict(t, bands, compressor) for t in texts]
            yield pa.record_batch([
                part.column(0), pa.array(n_words, pa.int64()),
                pa.array(code_points[offsets[1:]] - code_points[offsets[:-1]], pa.int64()),
                pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]], pa.int64()),
                pa.array([_dup_lines(t) for t in texts], pa.int64()), pa.array(repeats, pa.int64()),
                pa.array(failed), pa.array([not f and r[2] for f, r in zip(failed.tolist(), rated)], pa.bool_()),
                pa.array([r[0] for r in rated], pa.float64()), pa.array([r[1] for r in rated], pa.float64()),
            ], names=COLUMNS)

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "ratio", "bad_chunks"]
