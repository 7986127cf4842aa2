"""Token-ID output: documents as ids in checksummed, independently decodable blocks.

``write`` encodes whole texts with the tokenizers library, ends each document
with an id, and writes the ids in ascending order of the documents' ids.  The
output is a table of segments (Parquet, so any store that Spark can write to
will do); a segment's bytes are self-contained:

    magic, version, block size, counts of documents, ids and blocks    header
    lengths of the documents, their ids and which of these are there   index
    size and crc32 of each block                                       directory
    crc32 of all of the above
    the blocks: ``block_coder``'s range-coded ids, each reset, the last one padded with id 0
    (in segments of version 1, which ``read`` takes as well, ``context_coder``'s)

``read`` decodes the segments, checks every checksum, and returns each
document's ids and the number of ids before it.

The order comes from a range partitioning by document id and a sort within
each partition; the numbers before a document come from the segments' counts
(a running sum over partitions, one row each, and one within each partition),
so nothing is numbered by a single task.  A task that is run again writes the
same segments; Spark commits each output once.

Texts are cut at places where the tokenizer's pre-tokenization always cuts as
well (see ``cuts``), and pieces already encoded are looked up by a 64-bit hash:
the ids are those of the whole text.  With ``added_tokens`` the strings of the
tokenizer's special tokens in a text become these tokens, as the library does
by default, and pieces begin and end around each; without, they are ordinary text.

Defined results: a null text counts as empty (the end id alone); null ids come
first; rows that share an id are ordered by their text; other columns are not
read.  An empty table gives no segments.  A worker holds one segment (about
``SEGMENT_IDS`` ids, or one longer document) and at most ``CACHE`` pieces.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from . import block_coder as C
from . import context_coder

MAGIC, VERSION = b"IDSG", 2
_CODERS = {1: context_coder, 2: C}                          # by version of the format; the last one is written
SEGMENT_IDS = 2048 * C.BLOCK
CACHE = 3_000_000
PIECE_BYTES = 4 << 20                 # of text whose pieces are looked up together
#: bit 0: surely not white space; bit 1: a letter
_BEFORE = np.zeros(256, np.uint8)
_BEFORE[0x21:0x7F] = 1
_BEFORE[0x41:0x5B] = _BEFORE[0x61:0x7B] = 3
#: what is cut off after such a byte: bit 0: a space or newline; bit 1: a tab or ASCII punctuation; and bit 2: a letter
_HERE = np.zeros(256, np.uint8)
_HERE[[0x20, 0x0A]] = 1
_HERE[0x21:0x30] = _HERE[0x3A:0x7F] = _HERE[0x09] = 2
_HERE[0x41:0x5B] = _HERE[0x61:0x7B] = 4
_HEAD = struct.Struct("<4sHHIQI")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin (bytes of UTF-8): at documents, and at places that end a pre-token whatever stands around.

    * before a space or newline that follows a character which surely isn't white space;
    * between a letter and a tab or ASCII punctuation;
    * between a single newline, after such a character, and a letter.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    before, here = _BEFORE.take(data), _HERE.take(data)
    at = np.zeros(len(data), bool)
    line = np.flatnonzero(data[1:-1] == 0x0A) + 1
    at[line[(before[line - 1] > 0) & (here[line + 1] == 4)] + 1] = True
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80)) + 1    # U+00C0 to U+00FF
    before[latin] = np.where((data[latin] == 0x97) | (data[latin] == 0xB7), 1, 3)
    at[1:] |= (before[:-1] & here[1:]) > 0
    at[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(at)


#: a word of Latin letters with at most a space before it, and the byte-level alphabet's sign for each byte
_WORD = re.compile("[ ]?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_SIGNS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: b for b in _SIGNS} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_SIGNS}))}


def _is_plain(parts: dict) -> bool:
    """Whether the tokenizer is byte-level BPE without any step that could change a single word."""
    cut = parts["pre_tokenizer"] or {}
    return (parts["normalizer"] is None and parts["truncation"] is None and parts["padding"] is None
            and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True))


def _with_room(values: np.ndarray, size: int) -> np.ndarray:
    """``values``, or twice as much room (or more) with them at its beginning, if there are fewer than ``size``."""
    if size <= len(values):
        return values
    out = np.empty(max(size, 2 * len(values)), values.dtype)
    out[:len(values)] = values
    return out


class Encoder:
    """The tokenizers library, with the pieces encoded so far in flat arrays (about 20 bytes and its ids each)."""

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one core for each task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        known = [t for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        if any(t.lstrip or t.rstrip or t.single_word for t in known):
            raise ValueError("added tokens that depend on what stands around them don't fit pieces")
        # the longest of those that begin at one place, as in the library
        strings = sorted({t.content.encode() for t in known}, key=lambda x: (-len(x), x))
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.contents = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.plain = _WORD if _is_plain(json.loads(self.tokenizer.to_str())) else None
        self._forget()

    def _forget(self) -> None:
        # sorted hashes, and for each the number of its piece: where this one's ids begin, and in the end their number
        self.keys, self.piece, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.pieces = 0

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; a plain word is one pre-token, which the library's model takes as it is."""
        if self.plain is None:
            return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        tokenize, word, added = self.tokenizer.model.tokenize, self.plain.fullmatch, self.contents
        plain = [word(p) is not None and p not in added for p in pieces]
        # no plain word holds a newline, so all can be spelt in the byte-level alphabet at once
        spelt = "\n".join(compress(pieces, plain)).encode().decode("latin-1").translate(_BYTE_LEVEL)
        short = iter(spelt.split(chr(_BYTE_LEVEL[0x0A])))
        others = [p for p, is_plain in zip(pieces, plain) if not is_plain]
        long = iter(self.tokenizer.encode_batch(others, add_special_tokens=False))
        return [[t.id for t in tokenize(next(short))] if is_plain else next(long).ids for is_plain in plain]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces and merge their (sorted) hashes into the sorted ones."""
        got = [ids for lo in range(0, len(pieces), 4096) for ids in self._encoded(pieces[lo:lo + 4096])]
        ends = self.at[self.pieces] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        self.at = _with_room(self.at, self.pieces + 1 + len(got))
        self.ids = _with_room(self.ids, int(ends[-1]))
        self.ids[self.at[self.pieces]:ends[-1]] = np.fromiter(chain.from_iterable(got), np.uint32)
        self.at[self.pieces + 1:self.pieces + 1 + len(got)] = ends
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.piece = np.insert(self.piece, spot, np.arange(self.pieces, self.pieces + len(got), dtype=np.int32))
        self.pieces += len(got)

    def _around(self, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``starts`` with pieces of their own for the added tokens of each document."""
        raw = data.tobytes()
        if self.added is None or not self.added.search(raw):
            return starts
        spans = [m.span() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                 for m in self.added.finditer(raw, lo, hi)]
        if not spans:
            return starts
        a, b = np.array(spans, np.int64).T
        k = np.searchsorted(a, starts, "right") - 1
        inside = (k >= 0) & (starts > a[k]) & (starts < b[k])
        return np.unique(np.concatenate([starts[~inside], a, b[b < len(data)]]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each document's begin and the last one's end)."""
        starts = self._around(cuts(data, offsets), data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # pieces follow one another without a gap, so they are an Arrow column as they are
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)),
                                                                  pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        texts, borders = T.buffers(column.dictionary)
        found, first, inverse = np.unique(T.word_hashes(texts, borders[:-1], borders[1:]), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._forget()
        spot = np.searchsorted(self.keys, found)
        new = np.ones(len(found), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != found[inside]
        if new.any():
            self._learn(found[new], column.dictionary.take(pa.array(first[new])).cast(pa.string()).to_pylist())
            spot = np.searchsorted(self.keys, found)
        which = self.piece[spot][inverse][column.indices.to_numpy()]
        known = pa.LargeListArray.from_arrays(self.at[:self.pieces + 1], self.ids)
        ids = known.take(pa.array(which))
        upto = ids.offsets.to_numpy()
        return ids.values.to_numpy()[upto[0]:upto[-1]], (upto - upto[0])[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, added_tokens)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A segment of whole documents; ids below 65536."""
    lengths = np.array([len(x) for x in ids], "<u8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(flat) and int(flat.max()) > 0xFFFF:
        raise ValueError("ids of 65536 and above don't fit this format")
    n_blocks = -(-len(flat) // C.BLOCK)
    padded = np.zeros(n_blocks * C.BLOCK, np.uint16)
    padded[:len(flat)] = flat
    blocks = C.encode(padded.reshape(n_blocks, C.BLOCK))
    head = b"".join([
        _HEAD.pack(MAGIC, VERSION, C.BLOCK, len(ids), len(flat), n_blocks), lengths.tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids),
        np.array([len(b) for b in blocks], "<u4").tobytes(), np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes()])
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *blocks])


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their lengths, all ids) of a segment; raises ValueError if a checksum doesn't hold."""
    magic, version, block, n_docs, n_ids, n_blocks = _HEAD.unpack_from(blob)
    if magic != MAGIC or version not in _CODERS or block != C.BLOCK:
        raise ValueError("not a segment of this format")
    at = _HEAD.size

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype, n, at)
        at += out.nbytes
        return out

    lengths, doc_ids, there = take("<u8", n_docs), take("<i8", n_docs), take("u1", n_docs)
    sizes, sums = take("<u4", n_blocks), take("<u4", n_blocks)
    if struct.unpack_from("<I", blob, at)[0] != zlib.crc32(blob[:at]):
        raise ValueError("the index of a segment is damaged")
    ends = at + 4 + np.cumsum(sizes, dtype=np.int64)
    blocks = [blob[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]
    for i, (b, s) in enumerate(zip(blocks, sums.tolist())):
        if zlib.crc32(b) != s:
            raise ValueError(f"block {i} of a segment is damaged")
    ids = _CODERS[version].decode(blocks).reshape(-1)[:n_ids].astype(np.uint32)
    return [d if t else None for d, t in zip(doc_ids.tolist(), there.tolist())], lengths.astype(np.int64), ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
          added_tokens: bool = False) -> None:
    """Write the segments of all documents under ``path``."""
    def run(batches):
        enc, part, seq = encoder(tokenizer, added_tokens), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        names, ids, held = [], [], 0

        def segment():
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.array([held], pa.int64()), pa.array([pack(names, ids)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "segment"])

        for rows, data, offsets in T.doc_batches(batches, size=PIECE_BYTES):
            flat, at = enc.encode(data, offsets)
            for d, lo, hi in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                x = np.concatenate([flat[lo:hi], end])
                names.append(d)
                ids.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield segment()
                    names, ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield segment()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, segment binary")
     .write.parquet(path))


def read(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document; or ``derived`` columns of ids instead of ids."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                names, lengths, ids = unpack(row["segment"])
                ends = np.cumsum(lengths)
                n = len(names)
                raw = ids.astype("<u4")
                yield pa.record_batch([
                    pa.array(names, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                    pa.array(ends - lengths), pa.array(lengths),
                    pa.array([raw[e - m:e].tobytes() for e, m in zip(ends.tolist(), lengths.tolist())], pa.binary())],
                    names=["doc_id", "part", "seq", "at", "n_tokens", "ids"])

    table = spark.read.parquet(path)
    size = table.select("part", "seq", "n_ids")
    # one row for each partition of the output
    parts = (size.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
             .select("part", F.coalesce("before", F.lit(0)).alias("before")))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    base = (size.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part")
            .select("part", "seq", (F.col("before") + F.col("inside")).alias("base")))
    docs = (table.select("part", "seq", "segment")
            .mapInArrow(run, "doc_id long, part int, seq int, at long, n_tokens long, ids binary"))
    keep = [c.alias(name) for name, c in derived.items()] or [F.col("ids")]
    return (docs.select("doc_id", "part", "seq", "at", "n_tokens", *keep).join(base, ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *(derived or ["ids"])))
