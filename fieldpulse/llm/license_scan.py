"""Licence scan with a positional index of rare words.

Templates (key phrases and sentences of public licence notices) are indexed by
position: word -> (template, where the word stands in it).  Only a template's
rarest words, by inverse document frequency over the whole corpus, are indexed
(two of them, or one in a template of one word).  For each file the licence
words that it holds are looked up from the highest IDF down; postings whose
relative positions agree give the place where the template would begin; there
the mandatory words are compared one by one.  A template occurs only where its
indexed words do, so no occurrence is missed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case.

The score (0 to 1) is 0 without a licence phrase; else 0.5, plus a quarter if
a template that names a licence occurs, plus a quarter times the share of the
licence vocabulary's IDF weight found in the file.

Defined results: a null text counts as empty (no words, empty labels, score
0); one row out for one in, repeated rows and null ids included; columns other
than the id and text are neither read nor returned.  Whole texts are scanned;
document frequencies are counted over all rows; memory is bounded by one
Arrow batch slice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: (phrase, label); fixed values
BASE: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: labels that the method adds: phrases of public licence notices
NOTICES: tuple[tuple[str, str], ...] = (
    ("apache license version 2 0", "apache-2.0"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons", "creative-commons"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("boost software license", "bsl"),
    ("isc license", "isc"),
    ("provided as is without warranty of any kind", "no-warranty"),
)


def words_of(phrase: str) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", phrase.encode().lower())


def vocabulary(templates: Iterable[tuple[str, str]]) -> list[bytes]:
    return sorted({w for phrase, _ in templates for w in words_of(phrase)})


class _Texts:
    """Lower-cased texts of a piece, and places of given words in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.lower = T.LOWER[data]
        self.starts, self.ends, self.first = T.spans(self.lower, offsets, T.ALNUM)
        self.raw = self.lower.tobytes()

    def places(self, word: bytes) -> np.ndarray:
        """Numbers (over the piece) of the words that equal ``word``."""
        found, at, n = [], self.raw.find(word), len(word)
        while at >= 0:
            found.append(at)
            at = self.raw.find(word, at + 1)              # a hit across a border may hide one that overlaps it
        if not found:
            return np.zeros(0, np.int64)
        at = np.array(found)
        k = np.searchsorted(self.starts, at)
        k = np.minimum(k, len(self.starts) - 1)
        return k[(self.starts[k] == at) & (self.ends[k] == at + n)]


def document_frequency(docs: DataFrame, words: list[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word occurs, and how many documents there are (all rows)."""
    keys = T.hashes_of(words)
    order = np.argsort(keys)

    def run(batches):
        total, n = np.zeros(len(words), np.int64), 0
        for part, data, offsets in T.doc_batches(batches):
            lower = T.LOWER[data]
            starts, ends, first = T.spans(lower, offsets, T.ALNUM)
            found = T.word_hashes(lower, starts, ends)
            k = order[np.searchsorted(keys[order], found).clip(max=len(words) - 1)]
            known = np.flatnonzero(keys[k] == found)
            owner = np.searchsorted(first, known, "right")
            total += np.bincount(np.unique(owner * len(words) + k[known]) % len(words), minlength=len(words))
            n += part.num_rows
        yield pa.record_batch([pa.array(range(len(words) + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())],
                              names=["word", "n"])

    rows = (docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word int, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())         # one row for each vocabulary word
    got = {r["word"]: r["n"] for r in rows}
    return {w: got.get(i, 0) for i, w in enumerate(words)}, got.get(len(words), 0)


class PositionIndex:
    """Postings of each template's rarest words."""

    def __init__(self, templates: Iterable[tuple[str, str]], df: dict[bytes, int], n_docs: int, rare: int = 2):
        self.templates = [(words_of(phrase), label) for phrase, label in templates]
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for ws, _ in self.templates for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed: list[int] = []
        for k, (ws, _) in enumerate(self.templates):
            chosen = sorted(range(len(ws)), key=lambda i: (-self.idf[ws[i]], ws[i], i))[:rare]
            self.needed.append(len(chosen))
            for i in chosen:
                self.postings.setdefault(ws[i], []).append((k, i))
        self.by_idf = sorted(self.postings, key=lambda w: (-self.idf[w], w))

    def find(self, t: _Texts) -> list[np.ndarray]:
        """For each template, the numbers of the words at which it begins."""
        places: dict[bytes, np.ndarray] = {}

        def at(word: bytes) -> np.ndarray:
            if word not in places:
                places[word] = t.places(word)
            return places[word]

        begins: list[np.ndarray | None] = [None] * len(self.templates)
        for word in self.by_idf:                          # highest IDF first; an empty place list ends a template
            for k, i in self.postings[word]:
                if begins[k] is None:
                    begins[k] = at(word) - i
                elif len(begins[k]):
                    begins[k] = np.intersect1d(begins[k], at(word) - i)
        owner = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
        out = []
        for k, (ws, _) in enumerate(self.templates):
            b = begins[k]
            b = b[(b >= 0) & (b + len(ws) <= len(t.starts))] if b is not None else np.zeros(0, np.int64)
            good = [x for x in b.tolist() if owner[x] == owner[x + len(ws) - 1] and all(
                t.raw[t.starts[x + j]:t.ends[x + j]] == w for j, w in enumerate(ws))]
            out.append(np.array(sorted(set(good)), np.int64))
        return out


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: word and phrase counts, places, labels, score and the spans found."""
    templates = [*base, *notices]
    vocab = vocabulary(templates)
    df, n_docs = document_frequency(docs, vocab, text)
    index, n_base = PositionIndex(templates, df, n_docs), len(base)
    weight = sum(index.idf.values()) or 1.0

    def run(batches):
        for part, data, offsets in T.doc_batches(batches):
            t = _Texts(data, offsets)
            n = part.num_rows
            hits: dict[int, list[tuple[int, int]]] = {}
            for k, begins in enumerate(index.find(t)):
                for doc, x in zip((np.searchsorted(t.first, begins, "right") - 1).tolist(), begins.tolist()):
                    # a document without words has the same first word as the next one: take the one that holds x
                    hits.setdefault(doc, []).append((k, x - int(t.first[doc])))
            rows = {"n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n,
                    "labels": [""] * n, "score": [0.0] * n, "spans": [[] for _ in range(n)]}
            for d, found in hits.items():
                mine = [(k, x) for k, x in found if k < n_base]
                rows["n_base"][d] = len(mine)
                if mine:
                    rows["first_word"][d], rows["last_word"][d] = min(x for _, x in mine), max(x for _, x in mine)
                rows["base_labels"][d] = ",".join(sorted({index.templates[k][1] for k, _ in mine}))
                rows["labels"][d] = ",".join(sorted({index.templates[k][1] for k, _ in found}))
                held = {w for k, _ in found for w in index.templates[k][0]}
                share = sum(index.idf[w] for w in held) / weight
                named = any(k >= n_base or index.templates[k][1] != "reserved" for k, _ in found)
                rows["score"][d] = min(1.0, 0.5 + 0.25 * named + 0.25 * share)
                rows["spans"][d] = [{"label": index.templates[k][1], "word": x, "words": len(index.templates[k][0])}
                                    for k, x in sorted(found, key=lambda f: (f[1], f[0]))]
            span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))
            kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
                     "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
            yield pa.record_batch([part.column(0), pa.array(np.diff(t.first), pa.int64()),
                                   *(pa.array(rows[c], kinds[c]) for c in kinds)], names=["doc_id", "n_words", *kinds])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                               "base_labels string, labels string, score double, "
                               "spans array<struct<label:string,word:bigint,words:bigint>>")
