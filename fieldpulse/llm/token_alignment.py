"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

Tokenizer A is a byte-level BPE of the tokenizers library, B a BPE model of
sentencepiece.  Both encode a space and the text.

Method (token-byte incidence in hand-built CSR): a text's tokens are the rows
of a sparse matrix whose columns are its bytes.  Gustavson's row product A·Bᵀ
gives each A token its row of B tokens with the number of bytes they share:
the overlap links.  Those that hold the last byte of both tokens are the links
that end together.  Such places also cut the tokens into groups; the product
of the group-incidence matrices G_A·G_Bᵀ gives the links within a group, and
its row sizes tell how many there are before any is made.

A text is cut into segments before each ASCII space or newline that follows a
printable ASCII or Latin-1 letter byte.  No pre-token of A crosses such a
place, and no piece of B does: none holds U+2581 after another character, or a
newline (checked when the model is read, as is that it leaves texts as they are).  Both tokenizers therefore end a
token there, and a segment's tokens, groups and links depend on its bytes
alone.  Products are made once for each distinct segment of a worker (found by
a hash, then compared byte by byte), at most ``CACHE`` at a time.

Pair counts cover all documents: each document's distinct pairs are counted
within the task, summed by pair, and joined back.  The table of counts is
broadcast while it has at most ``BROADCAST_PAIRS`` rows, which is counted
first, and joined by shuffle beyond; results are the same.

Defined results: a null or empty text, or one whose tokens of A or of B do not
give its bytes back (U+2581 comes back as a space, for instance), has no
tokens: zeros and an empty digest.  Special tokens' strings are plain text.
Rows are kept as they are (repeated rows, null ids), one out for one in; other
columns are not read.  An empty table gives no rows.  Texts are worked on in
blocks of about ``BLOCK`` bytes that end between segments, so memory is bounded
by a block or the longest segment.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import _text as T

BLOCK = 1 << 20
CACHE = 1_000_000
BROADCAST_PAIRS = 2_000_000         # 16 bytes each, some 100 MB as a hash table of an executor
_SPACE = "▁"
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True


class Csr:
    """A sparse matrix in compressed rows: ``values[k]`` at column ``columns[k]`` for k in row i's ``at[i]:at[i + 1]``."""

    def __init__(self, at: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.at, self.columns, self.values, self.width = at, columns, values, width

    @classmethod
    def of_ends(cls, ends: np.ndarray, width: int) -> Csr:
        """Incidence of tokens that tile ``width`` bytes, given where each ends."""
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(width, dtype=np.int64),
                   np.ones(width, np.int64), width)

    @classmethod
    def of_members(cls, column: np.ndarray, width: int) -> Csr:
        """Incidence of rows that lie in one column each."""
        return cls(np.arange(len(column) + 1, dtype=np.int64), column.astype(np.int64), np.ones(len(column), np.int64), width)

    def rows(self) -> np.ndarray:
        """The row of each stored value."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(at, self.rows()[order], self.values[order], len(self.at) - 1)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """Terms of each row of the product: values of ``other``'s rows that its values select."""
        each = np.concatenate([[0], np.cumsum(np.diff(other.at)[self.columns])])
        return each[self.at[1:]] - each[self.at[:-1]]

    def product(self, other: Csr) -> Csr:
        """Gustavson's product: row i gathers ``other``'s rows j for its values at j; equal columns are added up."""
        n = np.diff(other.at)[self.columns]
        upto = np.cumsum(n)
        take = np.arange(int(n.sum())) + np.repeat(other.at[self.columns] - upto + n, n)
        row, column = np.repeat(self.rows(), n), other.columns[take]
        value = np.repeat(self.values, n) * other.values[take]
        key = row * other.width + column
        if len(key) and np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        row = key[first] // other.width if len(first) else first
        at = np.searchsorted(row, np.arange(len(self.at)))
        return Csr(at, key[first] - row * other.width, np.add.reduceat(value, first) if len(first) else value, other.width)


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at each document (none is empty), and before a space or newline after a solid byte."""
    before, two = np.zeros_like(data), np.zeros_like(data)
    before[1:], two[2:] = data[:-1], data[:-2]
    solid = _SOLID[before] | ((two == 0xC3) & (before >= 0x80))              # U+00C0 to U+00FF
    at = solid & ((data == 0x20) | (data == 0x0A))
    at[offsets[:-1]] = True
    return np.flatnonzero(at)


def _bytes_of_bpe(path: str) -> tuple[object, list[bytes]]:
    """The tokenizer and the bytes of each of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"         # one core for each task
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # byte-level entries write each byte as a character: printable ones as themselves, the others from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    code = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(code[c] for c in entry)
    return tokenizer, out


def _bytes_of_pieces(path: str) -> tuple[object, list[bytes]]:
    """The model and the bytes of each of its ids; refuses a model whose pieces could cross a segment's border."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces) or model.piece_to_id(_SPACE) == model.unk_id():
        raise ValueError("a piece of this model can cross a segment's border")
    out = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
    probe = " a  b\t \ufb01 \uff21 e\u0301  "             # a model that normalizes would change this
    if b"".join(out[i] for i in model.encode(probe)) != f" {probe}".encode():
        raise ValueError("this model changes its text or adds no space")
    return model, out


class _Flat:
    """Byte strings or arrays of varying length, end to end."""

    def __init__(self, dtype):
        self.data, self.at = np.zeros(0, dtype), np.zeros(1, np.int64)

    def extend(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.data = np.concatenate([self.data, data])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the chosen entries end to end, where each ends)."""
        n = self.at[which + 1] - self.at[which]
        upto = np.cumsum(n)
        return self.data[np.arange(int(n.sum())) + np.repeat(self.at[which] - upto + n, n)], upto


class Aligner:
    """Both tokenizers, and the alignment of the segments seen so far."""

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")

    def __init__(self, a_path: str, b_path: str):
        self.a, a_bytes = _bytes_of_bpe(a_path)
        self.b, b_bytes = _bytes_of_pieces(b_path)
        self.lone = [self.b.piece_to_id(_SPACE)]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (a_bytes, b_bytes))
        self.a_bytes, self.b_bytes = _Flat(np.uint8), _Flat(np.uint8)
        self.a_bytes.extend(np.frombuffer(b"".join(a_bytes), np.uint8), self.a_length)
        self.b_bytes.extend(np.frombuffer(b"".join(b_bytes), np.uint8), self.b_length)
        most = max(len(a_bytes), len(b_bytes))
        digits = [str(i).encode() for i in range(most)]
        width = len(digits[-1])
        self.digits = np.frombuffer(b"".join(d.ljust(width) for d in digits), np.uint8).reshape(most, width)
        self.n_digits = np.array(list(map(len, digits)), np.int64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.pairs, self.text = _Flat(np.uint8), _Flat(np.int64), _Flat(np.uint8)
        self.good, self.numbers = np.zeros(0, bool), np.zeros((0, len(self.NUMBERS)), np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for segments: each begins with a space (B adds its own) or with a newline."""
        a = [e.ids for lo in range(0, len(texts), 4096)
             for e in self.a.encode_batch(texts[lo:lo + 4096], add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        # before a newline, B's own space is a piece by itself; to an empty text it adds none
        return a, [self.lone if t == " " else ids if t[0] == " " else ids[1:] for t, ids in zip(texts, b)]

    def _restored(self, raw: np.ndarray, ids: list[list[int]], vocabulary: _Flat, sizes: np.ndarray) -> np.ndarray:
        """For each segment, whether its ids' bytes are its own."""
        n = np.array(list(map(len, ids)), np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
        joined, ends = vocabulary.take(flat)
        upto = np.concatenate([[0], ends])[np.cumsum(n)]
        same = np.diff(np.concatenate([[0], upto])) == sizes
        at, own = np.concatenate([[0], upto]), np.concatenate([[0], np.cumsum(sizes)])
        k = np.flatnonzero(same & (sizes > 0))
        lengths = sizes[k]
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        equal = joined[step + np.repeat(at[k], lengths)] == raw[step + np.repeat(own[k], lengths)]
        if len(k):
            same[k] = np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)
        return same

    def _learn(self, raw: np.ndarray, sizes: np.ndarray) -> None:
        """Append the alignment of new segments, given end to end."""
        whole = raw.tobytes()
        ends = np.cumsum(sizes)
        a, b = self.tokens([whole[e - s:e].decode() for e, s in zip(ends.tolist(), sizes.tolist())])
        good = self._restored(raw, a, self.a_bytes, sizes) & self._restored(raw, b, self.b_bytes, sizes)
        a = [x if g else [] for x, g in zip(a, good)]
        b = [x if g else [] for x, g in zip(b, good)]
        kept = np.where(good, sizes, 0)
        width, border = int(kept.sum()), np.cumsum(kept)
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        a_ids, b_ids = (np.fromiter((i for x in y for i in x), np.int64) for y in (a, b))
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])

        # overlap links; those at both tokens' last byte end together and cut the groups
        overlaps = Csr.of_ends(a_ends, width).product(Csr.of_ends(b_ends, width).transposed())
        left, right = overlaps.rows(), overlaps.columns
        together = a_ends[left] == b_ends[right]
        i, j = left[together], right[together]
        cuts = a_ends[i]
        groups_a = Csr.of_members(np.searchsorted(cuts, a_ends), len(cuts))
        groups_b = Csr.of_members(np.searchsorted(cuts, b_ends), len(cuts))
        shared = groups_a.product_sizes(groups_b.transposed())

        def per_segment(ends_of_rows: np.ndarray, weights=None) -> np.ndarray:
            return np.bincount(np.searchsorted(border, ends_of_rows), weights, len(sizes)).astype(np.int64)

        self.numbers = np.concatenate([self.numbers, np.stack([
            n_a, n_b, per_segment(cuts), per_segment(cuts), per_segment(a_ends[left]), per_segment(a_ends, shared)], axis=1)])
        self.pairs.extend(a_ids[i] * len(self.b_length) + b_ids[j], per_segment(cuts))
        self.text.extend(*self._group_texts(a_ids, b_ids, groups_a, groups_b, border, cuts, len(sizes)))
        self.bytes.extend(raw, sizes)
        self.good = np.concatenate([self.good, good])

    def _group_texts(self, a_ids, b_ids, groups_a: Csr, groups_b: Csr, border, cuts, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The groups' ids in decimal, ``a1,a2|b1;`` for each, as bytes, and their number in each segment."""
        of_a, of_b = groups_a.transposed(), groups_b.transposed()
        place_a = np.arange(len(a_ids)) + of_b.at[groups_a.columns]             # after the B tokens of earlier groups
        place_b = np.arange(len(b_ids)) + of_a.at[groups_b.columns + 1]         # after the A tokens of its group
        ids, mark = np.zeros(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a_ids, b_ids
        mark[place_a[of_a.at[1:] - 1]], mark[place_b[of_b.at[1:] - 1]] = ord("|"), ord(";")
        length = self.n_digits[ids]
        wide = np.concatenate([self.digits[ids], np.zeros((len(ids), 1), np.uint8)], axis=1)
        wide[np.arange(len(ids)), length] = mark
        flat = wide[np.arange(wide.shape[1]) <= length[:, None]]
        upto = np.concatenate([[0], np.cumsum(length + 1)])
        last = upto[place_b[of_b.at[1:] - 1] + 1] if len(cuts) else np.zeros(0, np.int64)      # where each group's text ends
        groups = np.cumsum(np.bincount(np.searchsorted(border, cuts), minlength=n))
        return flat, np.diff(np.concatenate([[0], np.concatenate([[0], last])[groups]]))

    def look_up(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entry of each segment; new ones are aligned first."""
        ends = np.concatenate([starts[1:], [len(data)]]).astype(np.int64)
        found, first, inverse = np.unique(T.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.good) > CACHE:
            self._forget()
        spot = np.searchsorted(self.keys, found)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == found[known]
        if not known.all():
            self._add(data, starts, ends, first[~known])
            fresh = np.arange(len(self.good) - int((~known).sum()), len(self.good))
            self.keys = np.insert(self.keys, spot[~known], found[~known])
            self.entry = np.insert(self.entry, spot[~known], fresh)
            spot = np.searchsorted(self.keys, found)
        which = self.entry[spot][inverse]
        # equal hashes are not enough: every segment is compared with its entry's bytes
        odd = self.bytes.at[which + 1] - self.bytes.at[which] != ends - starts
        if not odd.any():
            odd = ~np.logical_and.reduceat(self.bytes.take(which)[0] == data, starts)
        else:
            raw = data.tobytes()
            odd = np.array([raw[s:e] != self.bytes.data[self.bytes.at[w]:self.bytes.at[w + 1]].tobytes()
                            for s, e, w in zip(starts.tolist(), ends.tolist(), which.tolist())])
        if odd.any():
            k = np.flatnonzero(odd)
            self._add(data, starts, ends, k)                                # entries that no hash leads to
            which[k] = np.arange(len(self.good) - len(k), len(self.good))
        return which

    def _add(self, data, starts, ends, which) -> None:
        sizes = ends[which] - starts[which]
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._learn(data[step + np.repeat(starts[which], sizes)], sizes)

    def align(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """Blocks of whole segments: (first and last document, good and numbers of each document of the block, the group
        texts and where each document's end, its pair codes and where these end)."""
        starts = segment_starts(data, offsets)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK)))
            stop = int(starts[hi]) if hi < len(starts) else len(data)
            base = int(starts[lo])
            part = starts[lo:hi] - base
            which = self.look_up(data[base:stop], part)
            first_doc = int(np.searchsorted(offsets, base, "right")) - 1
            last_doc = int(np.searchsorted(offsets, stop, "left"))
            at = np.searchsorted(part, np.maximum(offsets[first_doc:last_doc] - base, 0))
            good = np.logical_and.reduceat(self.good[which], at)
            numbers = np.add.reduceat(self.numbers[which], at, axis=0)
            text, text_ends = self.text.take(which)
            pairs, pair_ends = self.pairs.take(which)
            last = np.concatenate([at[1:], [len(part)]]) - 1
            yield first_doc, good, numbers, text, text_ends[last], pairs, pair_ends[last]
            lo = hi


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    return Aligner(a_path, b_path)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every document with a space before it."""
    return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


class _Rows:
    """What the blocks of some documents add up to."""

    def __init__(self, n: int, empty: np.ndarray):
        self.good, self.numbers = ~empty, np.zeros((n, len(Aligner.NUMBERS)), np.int64)
        self.digests, self.begun = [hashlib.sha256() for _ in range(n)], np.zeros(n, bool)
        self.pairs: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.times: list[list[np.ndarray]] = [[] for _ in range(n)]

    def add(self, first, good, numbers, text, text_ends, pairs, pair_ends, vocabulary: int) -> None:
        n = len(good)
        self.good[first:first + n] &= good
        self.numbers[first:first + n] += numbers
        of = np.repeat(np.arange(n), np.diff(np.concatenate([[0], pair_ends])))
        code, times = np.unique(of * vocabulary + pairs, return_counts=True)
        at = np.searchsorted(code, np.arange(n + 1) * vocabulary).tolist()
        code %= vocabulary
        raw, begin = memoryview(text), 0
        for k, end in enumerate(text_ends.tolist()):
            d = first + k
            if end > begin:
                if self.begun[d]:
                    self.digests[d].update(b";")
                self.digests[d].update(raw[begin:end - 1])          # the last mark stands between groups only
                self.begun[d] = True
            begin = end
            self.pairs[d].append(code[at[k]:at[k + 1]])
            self.times[d].append(times[at[k]:at[k + 1]])

    def batch(self, ids: pa.Array, first_row: int) -> pa.RecordBatch:
        good = self.good & (self.numbers[:, 0] > 0)
        numbers = np.where(good[:, None], self.numbers, 0)
        none = np.zeros(0, np.int64)
        pairs = [np.concatenate(x) if g and x else none for x, g in zip(self.pairs, good)]
        times = [np.concatenate(x) if g and x else none for x, g in zip(self.times, good)]
        at = pa.array(np.concatenate([[0], np.cumsum(list(map(len, pairs)))]).astype(np.int32), pa.int32())
        return pa.record_batch([
            pa.array(np.arange(first_row, first_row + len(good)), pa.int64()), ids,
            *[pa.array(numbers[:, k], pa.int64()) for k in range(numbers.shape[1])],
            pa.array([d.hexdigest() if g else "" for d, g in zip(self.digests, good)], pa.string()),
            pa.ListArray.from_arrays(at, pa.array(np.concatenate([none, *pairs]), pa.int64())),
            pa.ListArray.from_arrays(at, pa.array(np.concatenate([none, *times]), pa.int64()))],
            names=["row", "doc_id", *Aligner.NUMBERS, "groups_sha256", "pairs", "times"])


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_shared, groups_sha256, pairs, times) of each document.

    ``pairs`` are the distinct id pairs that its links hold, as A's id times
    B's vocabulary plus B's id, and ``times`` how often each occurs; a very long
    document may list a pair once for each of its blocks.  n_overlaps counts A-B
    tokens that share bytes, n_shared those that share a group.
    """
    def run(batches):
        table, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        vocabulary = len(table.a_length) * len(table.b_length)
        for rows, data, offsets in T.doc_batches(batches):
            out = _Rows(rows.num_rows, np.diff(offsets) == 0)
            for block in table.align(*_spaced(data, offsets)):
                out.add(*block, vocabulary)
            yield out.batch(rows.column(0), row)
            row += rows.num_rows

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"row long, doc_id {kind}, " + "".join(f"{n} long, " for n in Aligner.NUMBERS)
                          + "groups_sha256 string, pairs array<long>, times array<long>")


def links(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap", doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, bytes) of every link: token numbers within the document, ids, bytes shared.

    ``kind``: ``overlap`` (tokens that share bytes), ``end`` (those that end
    together) or ``group`` (tokens of one group; bytes shared may be none).
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(kind)

    def run(batches):
        table = aligner(a_path, b_path)
        for rows, data, offsets in T.doc_batches(batches):
            spaced, at = _spaced(data, offsets)
            for d in range(rows.num_rows):
                if offsets[d] < offsets[d + 1]:
                    yield from _links_of(table, rows.slice(d, 1).column(0), spaced[at[d]:at[d + 1]], kind)

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    name = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {name}, a_at long, b_at long, a_id long, b_id long, bytes long")


def _links_of(table: Aligner, name: pa.Array, data: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Links of one document, block by block; none if a token sequence does not give its bytes back."""
    starts = segment_starts(data, np.array([0, len(data)]))
    bounds = np.append(starts, len(data))
    sizes = np.diff(bounds)
    raw = data.tobytes()
    a, b = table.tokens([raw[s:e].decode() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
    if not (table._restored(data, a, table.a_bytes, sizes) & table._restored(data, b, table.b_bytes, sizes)).all():
        return
    seen_a = seen_b = 0
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK // 16)))
        a_ids, b_ids = (np.array([i for x in y[lo:hi] for i in x], np.int64) for y in (a, b))
        width = int(sizes[lo:hi].sum())
        a_ends, b_ends = np.cumsum(table.a_length[a_ids]), np.cumsum(table.b_length[b_ids])
        overlap = Csr.of_ends(a_ends, width).product(Csr.of_ends(b_ends, width).transposed())
        i, j, shared = overlap.rows(), overlap.columns, overlap.values
        together = a_ends[i] == b_ends[j]
        if kind == "end":
            i, j, shared = i[together], j[together], shared[together]
        elif kind == "group":
            cuts = a_ends[i[together]]
            members = [Csr.of_members(np.searchsorted(cuts, e), len(cuts)) for e in (a_ends, b_ends)]
            both = members[0].product(members[1].transposed())
            code = i * len(b_ids) + j
            i, j = both.rows(), both.columns
            spot = np.searchsorted(code, i * len(b_ids) + j)
            spot[spot == len(code)] = 0
            shared = np.where(code[spot] == i * len(b_ids) + j, shared[spot], 0)
        yield pa.record_batch([pa.array(name.to_pylist() * len(i), name.type), pa.array(i + seen_a), pa.array(j + seen_b),
                               pa.array(a_ids[i]), pa.array(b_ids[j]), pa.array(shared)],
                              names=["doc_id", "a_at", "b_at", "a_id", "b_id", "bytes"])
        seen_a, seen_b, lo = seen_a + len(a_ids), seen_b + len(b_ids), hi


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): how many links of all documents hold a pair, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = counts.withColumn("b", F.col("pair") % b_size)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
              broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each document: ``align``'s counts, and n_best and count_sum from the pair counts of all documents."""
    path = scratch_path(spark, "alignment")
    align(docs, a_path, b_path, doc_id, text).write.parquet(f"{path}/docs")
    aligned = spark.read.parquet(f"{path}/docs")
    pair_counts(aligned, len(_bytes_of_pieces(b_path)[1])).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    sums = (each.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(counts, "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    out = aligned.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", "n_overlaps", "n_shared")
