"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode(docs)`` adds the ids of each whole text as packed little-endian
unsigned 32-bit integers, ``decode(encoded)`` gives the raw bytes back.

A long text is cut where a match of the pattern surely ends: between a
character that is not white space and an ASCII space or newline after it.  No
alternative of the pattern matches across such a place, and none looks behind,
so the pieces give the same ids as the whole.  A long run of white space (on
which the pattern's look-ahead would run out of stack) is a single match
without its last character when a word follows it, or as a whole at the end of
the text, and goes to the merge step directly.

Defined results: a null text counts as empty; an empty text has no ids; rows
are kept as they are (repeated rows, null ids, any order), one out for one in;
columns other than the id and text are neither read nor returned.  Memory is
bounded by one Arrow batch and one text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

LONG_TEXT = 1 << 16          # characters after which a text is cut at the next safe boundary
LONG_SPACE = 512             # white-space characters that count as a long run
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: the pattern's white space (Unicode White_Space; str.isspace has four control characters more)
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


class Codec:
    """tiktoken over one rank file, safe for texts of any length."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without long runs of white space, cut at safe boundaries."""
        at = 0
        while len(text) - at > LONG_TEXT:
            cut = _SAFE.search(text, at + LONG_TEXT)
            if cut is None:
                break
            yield self.encoding.encode_ordinary(text[at:cut.start()])
            at = cut.start()
        yield self.encoding.encode_ordinary(text[at:] if at else text)

    def _chunks(self, text: str) -> Iterator[list[int]]:
        at = 0
        for run in _SPACES.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from self._plain(text[at:run.start()])
            yield self.encoding._encode_single_piece(text[run.start():end])
            at = end
        yield from self._plain(text[at:])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG_SPACE:
            return self.encoding.encode_ordinary(text)
        if len(text) <= LONG_TEXT and _SPACES.search(text) is None:
            return self.encoding.encode_ordinary(text)
        return [i for part in self._chunks(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary): the ids of each text as packed unsigned 32-bit integers."""
    def run(batches):
        c = codec(rank_file, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [np.array(c.encode(t), "<u4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(T.tidy(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, raw binary): the bytes that the ids stand for; null ids count as none."""
    def run(batches):
        c = codec(rank_file, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                raw = [c.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(raw, pa.binary())],
                                      names=["doc_id", "ids", "raw"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(T.tidy(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary, raw binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
               keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text encoded and decoded again, and its ids if wished.

    One pass with one Python worker for each task: the digests of ``encode``'s
    ids (decimal, joined by a space) and of ``decode``'s bytes.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def run(batches):
        import hashlib
        c = codec(rank_file, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, ids_sha, raw_sha, packed = [], [], [], []
                for t in part.column(1).to_pylist():
                    ids = c.encode(t)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if keep_ids:
                        packed.append(np.array(ids, "<u4").tobytes())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                       pa.array(raw_sha, pa.string()), *([pa.array(packed, pa.binary())] if keep_ids else [])],
                                      names=names)

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(T.tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                               + ", ids binary" * keep_ids)
