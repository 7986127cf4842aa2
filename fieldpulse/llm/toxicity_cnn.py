"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of three rows of a hashed embedding table: two hash
functions of the word (so that a collision of one of them carries half a word
only) and one of its first bytes.  Filters of several widths run over the
words, max pooling over the whole text gives one value per filter, and a
logistic layer gives the raw score.  A word (or beginning) that a single text of
a shard (below) holds is not learned there: it could only be learned by heart, and
then hides what texts have in common.

Thresholds are calibrated by language, by cross-fitting: the labelled rows are dealt
in turn into ``Config.folds`` parts, those of each label and language apart; each part
is scored by a network fitted on the others, and every language (``Config.languages`` most frequent
ones) gets the cut of the best F1 over these scores (all of them, counted on a
grid of 1 / ``GRID``).  Rows of other languages count for it as
much as ``Config.prior`` toxic rows of its own would, so a rare language leans
on the others and a frequent one on itself, without a limit between.  The
network that scores is fitted on all parts.  The language is guessed
from the text's own hashed words (naive Bayes over the same rows); a threshold
is mapped to ``THRESHOLD`` by a piecewise linear curve, so one cut holds for all
languages.  Labels, the language column, the source and the id are never inputs
of a score.

Training reads every labelled row, whole texts.  They are dealt by a hash of the id
to shards of about ``Config.shard_bytes`` of text, and kept there as hashed words.
A round is one job with a task for each network and shard: the task begins with
the network of the round before, reads its shard once, and hands on what moved.
The moves are averaged over the shards (a row of the embedding table over the
times it moved in each), by network and stretch of the table, so what comes back
to the driver are networks of a fixed size.  A single shard needs no averaging
and is read as often as wanted in one round.  Scoring reads every row, whole
texts, in bounded blocks of words.

Defined results: a null or empty text (or one without words) scores like a
text in which no filter fires; labels that are null are not used, a document
labelled more than once is toxic if any label says so, and learned from once
(by its smallest text) if rows repeat its id; without labelled rows of
both kinds every score is 0; one row out for one in, repeated rows and null
ids included; columns other than the id and text are neither read nor returned
by ``score`` and all kept by ``reject``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T

THRESHOLD = 0.3
GRID = 1024                          # places of a threshold between two whole logits
_BLOCK = 1 << 16                     # words scored at a time
_STRETCH = 1024                      # rows of the embedding table that are averaged together
_SENT_LABELS = 2_000_000             # ids with a label that are broadcast; more are joined by a shuffle
_CACHED_ROWS = 512                   # rows of a shard that Spark keeps in one batch


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 16           # at most
    dim: int = 8
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    prefix_bytes: int = 4
    shard_bytes: int = 32 << 20      # text that one training task holds, about
    folds: int = 3                   # parts that thresholds are calibrated on, each by a network fitted on the others
    prior: float = 10.0              # toxic rows that other languages stand for in a language's threshold
    languages: int = 32              # languages with a threshold of their own
    epochs: int = 2                  # times that training reads every row, at least
    readings: int = 64_000           # texts that it reads in all, at least: few rows are read more often
    drop: float = 0.5                # share of the places that a training step leaves out of the maxima
    batch: int = 32
    rate: float = 0.12
    seed: int = 7


def word_ids(data: np.ndarray, offsets: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(ids [words, 3], first): rows of the embedding table for each word, and each text's first word."""
    lower = T.LOWER[data]
    starts, ends, first = T.spans(lower, offsets, T.ALNUM)
    mask, n = np.uint64(config.buckets - 1), config.buckets
    whole = T.word_hashes(lower, starts, ends)
    head = T.word_hashes(lower, starts, np.minimum(ends, starts + config.prefix_bytes))
    ids = np.empty((len(starts), 3), np.int32)
    ids[:, 0] = whole & mask
    ids[:, 1] = (T.mix64(whole + np.uint64(0x51ED27)) & mask).astype(np.int32) + n
    ids[:, 2] = (head & mask).astype(np.int32) + 2 * n
    return ids, first


class Network:
    """Embeddings, filters by width, and the logistic layer."""

    def __init__(self, config: Config):
        self.config = config
        rng = np.random.default_rng(config.seed)
        self.embed = rng.normal(0, 0.05, (3 * config.buckets + 1, config.dim)).astype(np.float32)
        self.embed[-1] = 0                               # stands for what is not learned
        self.kernels = {w: rng.normal(0, 0.4, (w, config.dim, config.filters)).astype(np.float32) for w in config.widths}
        self.shift = {w: np.full(config.filters, 0.02, np.float32) for w in config.widths}
        self.out = rng.normal(0, 0.4, len(config.widths) * config.filters).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: np.random.Generator | None = None):
        """Max-pooled filters of each text; when training also the words' vectors and the places of the maxima."""
        c, n_docs, n = self.config, len(first) - 1, len(ids)
        top = np.zeros((n_docs, len(c.widths) * c.filters), np.float32)
        at = np.full(top.shape, -1, np.int64)
        if not n:
            return (top, None, at) if places is not None else top
        owner = np.repeat(np.arange(n_docs), np.diff(first))
        vectors = None
        for lo in range(0, n, _BLOCK):
            hi = min(n, lo + _BLOCK)
            x = self.embed[ids[lo:min(n, hi + max(c.widths) - 1)]].sum(1)
            if places is not None:                       # a training batch: one block, unless texts are long
                vectors = x[:hi - lo] if vectors is None else np.concatenate([vectors, x[:hi - lo]])
            docs, begin = np.unique(owner[lo:hi], return_index=True)
            for k, w in enumerate(c.widths):
                m = min(hi - lo, len(x) - w + 1)
                z = np.full((hi - lo, c.filters), -1e9, np.float32)
                if m > 0:
                    z[:m] = self.shift[w] + sum(x[j:j + m] @ self.kernels[w][j] for j in range(w))
                    z[:m][owner[lo:lo + m] != owner[lo + w - 1:lo + w - 1 + m]] = -1e9
                cols = slice(k * c.filters, (k + 1) * c.filters)
                if places is not None:
                    z[places.random(len(z)) < c.drop] = -1e9
                best = np.maximum.reduceat(z, begin, axis=0)
                if places is not None:
                    for i, d in enumerate(docs):
                        b, e = begin[i], begin[i + 1] if i + 1 < len(begin) else hi - lo
                        arg = z[b:e].argmax(0)
                        better = best[i] > np.maximum(top[d, cols], 0)
                        at[d, cols] = np.where(better, arg + b + lo, at[d, cols])
                top[docs, cols] = np.maximum(top[docs, cols], best)
        return (top, vectors, at) if places is not None else top

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (self.pooled(ids, first) @ self.out + self.bias[0]).astype(np.float64)

    def step(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, memory: dict,
             rng: np.random.Generator) -> None:
        """One Adagrad step on a batch of texts; only words under a maximum move."""
        c = self.config
        top, vectors, at = self.pooled(ids, first, rng)
        p = 1 / (1 + np.exp(-(top @ self.out + self.bias[0])))
        slope = ((p - y) * weight / len(y)).astype(np.float32)
        back = slope[:, None] * self.out * (at >= 0)
        words, moves = [], []
        for k, w in enumerate(c.widths):
            cols = slice(k * c.filters, (k + 1) * c.filters)
            doc, f = np.nonzero(at[:, cols] >= 0)
            if not len(doc):
                continue
            place, g = at[doc, cols.start + f], back[doc, cols.start + f]
            grad = np.zeros_like(self.kernels[w])
            for j in range(w):
                np.add.at(grad[j].T, f, g[:, None] * vectors[place + j])
                words.append(place + j)
                moves.append(g[:, None] * self.kernels[w][j].T[f])
            self._move(self.kernels[w], grad, memory, ("kernel", w))
            self._move(self.shift[w], np.bincount(f, g, c.filters).astype(np.float32), memory, ("shift", w))
        self._move(self.out, top.T @ slope + 1e-4 * self.out, memory, "out")
        self._move(self.bias, np.array([slope.sum()], np.float32), memory, "bias")
        if words:
            rows, inverse = np.unique(ids[np.concatenate(words)].ravel(), return_inverse=True)
            grad = np.zeros((len(rows), c.dim), np.float32)
            np.add.at(grad, inverse, np.repeat(np.concatenate(moves), 3, axis=0))
            seen = memory["embed"]
            seen[rows] += (grad ** 2).mean(1)
            memory["moves"][rows] += 1
            self.embed[rows] -= c.rate * grad / np.sqrt(seen[rows])[:, None]

    def _move(self, value: np.ndarray, grad: np.ndarray, memory: dict, name) -> None:
        seen = memory[name]
        seen += grad ** 2
        value -= self.config.rate * grad / np.sqrt(seen)

    def dense(self) -> dict:
        """All but the embeddings, by the names that ``memory`` has for them."""
        return {**{("kernel", w): k for w, k in self.kernels.items()}, **{("shift", w): b for w, b in self.shift.items()},
                "out": self.out, "bias": self.bias}

    def memory(self) -> dict:
        """What Adagrad has seen, and how often each row of the embeddings has moved: nothing yet."""
        seen = np.full(len(self.embed), 1e-6, np.float32)
        seen[-1] = np.inf                                # never moves
        return {"embed": seen, "moves": np.zeros(len(self.embed), np.float32),
                **{name: np.full_like(value, 1e-4) for name, value in self.dense().items()}}


class Model:
    """Network, language guess and one threshold (a logit) per language."""

    def __init__(self, network: Network | None, languages: list[str] = (), words: np.ndarray | None = None,
                 cuts: np.ndarray | None = None):
        self.network, self.languages, self.words, self.cuts = network, list(languages), words, cuts

    def guess(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most likely language of each text, by its words."""
        total = np.zeros((len(first) - 1, len(self.languages)))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for lo in range(0, len(ids), _BLOCK):
            docs, begin = np.unique(owner[lo:lo + _BLOCK], return_index=True)
            total[docs] += np.add.reduceat(self.words[ids[lo:lo + _BLOCK, 0]], begin, axis=0)
        return total.argmax(1)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(first) - 1)
        p = 1 / (1 + np.exp(-np.clip(self.network.logits(ids, first), -40, 40)))
        cut = 1 / (1 + np.exp(-self.cuts[self.guess(ids, first)]))
        return np.where(p < cut, THRESHOLD * p / cut, THRESHOLD + (1 - THRESHOLD) * (p - cut) / (1 - cut))


def best_cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit of the best weighted F1, a third of the way from the highest text below it to the lowest one above."""
    order = np.argsort(-logits, kind="stable")
    s, hit, read = logits[order], np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (read + (y * weight).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else s[k] - 2.0
    return float(np.clip(below + (s[k] - below) / 3, -12, 12))


class Texts:
    """Texts to learn from: hashed words in one array, where each text's begin, and labels."""

    def __init__(self, words: np.ndarray, first: np.ndarray, y: np.ndarray):
        self.words, self.first, self.y = words, first, y
        self.alone = None

    @classmethod
    def of(cls, texts: list, rows: np.ndarray, config: Config) -> Texts:
        ids = [texts[i][0] for i in rows]
        return cls(packed(np.concatenate(ids), config), np.concatenate([[0], np.cumsum([len(x) for x in ids])]),
                   np.array([texts[i][1] for i in rows], np.float32))

    def leave_out(self) -> None:
        """From now on leave out the words and beginnings that one text only holds."""
        owner = np.repeat(np.arange(len(self.y), dtype=np.int32), np.diff(self.first))
        whole = self.words[:, 0].astype(np.uint32) << np.uint32(16) | self.words[:, 1]
        self.alone = [_alone(key, owner, len(self.y)) for key in (whole, self.words[:, 2])]

    def take(self, rows, config: Config) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of some of the texts."""
        at = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in rows])
        ids = self.words[at] + np.arange(3, dtype=np.int32) * config.buckets
        if self.alone is not None:
            ids[self.alone[0][at], :2] = 3 * config.buckets
            ids[self.alone[1][at], 2] = 3 * config.buckets
        return ids, np.concatenate([[0], np.cumsum(self.first[np.asarray(rows) + 1] - self.first[rows])])


def packed(ids: np.ndarray, config: Config) -> np.ndarray:
    """Rows of the embedding table within their third of it, in 16 bits."""
    return (ids - np.arange(3, dtype=np.int32) * config.buckets).astype(np.uint16)


def _alone(key: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whether each word's key stands in one text only; a part of the keys at a time."""
    alone = np.zeros(len(key), bool)
    for part in range(16):
        at = np.flatnonzero((key & 15) == part)
        _, word = np.unique(key[at], return_inverse=True)
        lowest, highest = np.full(word.max(initial=0) + 1, n, np.int32), np.full(word.max(initial=0) + 1, -1, np.int32)
        np.minimum.at(lowest, word, owner[at])
        np.maximum.at(highest, word, owner[at])
        alone[at] = (lowest == highest)[word]
    return alone


def passes_of(n: int, config: Config) -> int:
    """How often training reads each of n rows."""
    return max(config.epochs, -(-config.readings // max(1, n)))


def learn(network: Network, memory: dict, texts: Texts, share: float, passes: int, seed: int) -> np.ndarray:
    """Read the texts some times; returns the rows of the embedding table that they use, without those of a single text."""
    config = network.config
    rng = np.random.default_rng(seed)
    texts.leave_out()
    used = np.zeros(len(network.embed), bool)
    weight = np.where(texts.y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    by_size = np.argsort(np.diff(texts.first), kind="stable")
    batches = [by_size[i:i + config.batch] for i in range(0, len(by_size), config.batch)]
    weights, total, late = [network.embed, *network.dense().values()], None, passes - passes // 2
    for turn in range(passes):
        for b in rng.permutation(len(batches)):
            ids, first = texts.take(batches[b], config)
            used[ids.ravel()] = True
            network.step(ids, first, texts.y[batches[b]], weight[batches[b]], memory, rng)
        if turn >= passes - late:
            total = [w.copy() for w in weights] if total is None else [t + w for t, w in zip(total, weights)]
    for w, t in zip(weights, total):                     # the mean after each of the later passes
        w[...] = t / late
    used[-1] = False
    return used


def fit_network(texts: list, rows: np.ndarray, config: Config) -> Network | None:
    """A network fitted on some of the texts in one shard; None if they are not of both labels."""
    if len({texts[i][1] for i in rows}) < 2:
        return None
    shard, network = Texts.of(texts, rows, config), Network(config)
    used = learn(network, network.memory(), shard, shard.y.mean(), passes_of(len(rows), config), config.seed)
    network.embed[~used] = 0
    return network


def _cells(logits: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logits, -12, 12) * GRID).astype(np.int32)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _blocks(n: int, config: Config) -> Iterator[np.ndarray]:
    return (np.arange(i, min(n, i + config.batch)) for i in range(0, n, config.batch))


def with_cuts(model: Model, guess: np.ndarray, cell: np.ndarray, toxic: np.ndarray, n: np.ndarray, config: Config) -> Model:
    """The model with a threshold for each language, from how many rows of a guess and label have a logit."""
    model.cuts = np.zeros(len(model.languages))
    if (n * toxic).sum() > 0:
        for k in range(len(model.cuts)):
            mine = guess == k
            others = (n * toxic)[~mine].sum()
            model.cuts[k] = best_cut(cell / GRID, toxic, n * np.where(mine, 1.0, min(1.0, config.prior / max(1.0, others))))
    return model


def _log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log(counts / counts.sum(0)).astype(np.float32)


def fit(texts: list[tuple[np.ndarray, int, str]], config: Config = Config()) -> Model:
    """A model from (word ids, label, language) of rows in one shard, all fits one after another."""
    network = fit_network(texts, np.arange(len(texts)), config)
    if network is None:
        return Model(None)
    names, seen = np.unique([t[2] or "" for t in texts], return_counts=True)
    languages = sorted(names[np.lexsort((names, -seen))[:config.languages]].tolist())
    counts = np.ones((config.buckets, len(languages)), np.float32)
    for ids, _, lang in texts:
        if (lang or "") in languages:
            np.add.at(counts[:, languages.index(lang or "")], ids[:, 0], 1)
    model, found = Model(network, languages, _log_shares(counts)), []
    fold = np.random.default_rng(config.seed).integers(0, config.folds, len(texts))
    for part in range(config.folds):
        rows, judge = np.flatnonzero(fold == part), fit_network(texts, np.flatnonzero(fold != part), config)
        if judge is not None and len(rows):
            shard = Texts.of(texts, rows, config)
            for b in _blocks(len(rows), config):
                ids, first = shard.take(b, config)
                found.append((model.guess(ids, first), _cells(judge.logits(ids, first)), shard.y[b]))
    guess, cell, toxic = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0),) * 3
    return with_cuts(model, guess, cell, toxic, np.ones(len(cell)), config)


def shards(docs: DataFrame, labels: DataFrame, config: Config) -> tuple[DataFrame, int]:
    """(fold, toxic, lang, ids) of every labelled id's row with the smallest text, a partition for each shard, and their number."""
    def ids_of(batches):
        last, dealt, shard = None, {}, TaskContext.get().partitionId()
        for part, data, offsets in T.doc_batches(batches):
            ids, first = word_ids(data, offsets, config)
            words, names = packed(ids, config), part.column(0).to_pylist()
            new = [a != b for a, b in zip(names, [last, *names])]
            last, fold = names[-1] if names else last, []
            for kind, first_row in zip(zip(part.column(2).to_pylist(), part.column(3).to_pylist()), new):
                dealt[kind] = dealt.get(kind, shard) + first_row
                fold.append(dealt[kind] % config.folds)
            found = [words[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.record_batch([pa.array(fold, pa.int32()), part.column(2), part.column(3), pa.array(found, pa.binary())],
                                  names=["fold", "toxic", "lang", "ids"]).filter(pa.array(new))

    docs = docs.filter("text is not null")
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    size = docs.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-size // config.shard_bytes))
    few = known.count() <= _SENT_LABELS
    dealt = docs.join(F.broadcast(known) if few else known, "doc_id").repartition(n, "doc_id")
    rows = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "toxic", "lang")
    return (rows.sortWithinPartitions("doc_id", "text", "lang")
            .mapInArrow(T.tidy(ids_of), "fold int, toxic int, lang string, ids binary"), n)


def _texts(batch: pa.RecordBatch) -> Texts:
    data, offsets = T.buffers(batch.column(3))
    return Texts(data.view(np.uint16).reshape(-1, 3), offsets // 6, batch.column(1).to_numpy().astype(np.float32))


def _joined(batches, leave: int) -> Texts:
    """The texts of a shard but those of a part."""
    found = [_texts(b.filter(pa.array(b.column(0).to_numpy() != leave))) for b in batches]
    found = [t for t in found if len(t.y)]
    if not found:
        return Texts(np.zeros((0, 3), np.uint16), np.zeros(1, np.int64), np.zeros(0, np.float32))
    sizes = np.concatenate([np.diff(t.first) for t in found])
    return Texts(np.concatenate([t.words for t in found]), np.concatenate([[0], np.cumsum(sizes)]),
                 np.concatenate([t.y for t in found]))


def _moved(key: tuple[pa.Scalar, ...], moves: pa.Table) -> pa.Table:
    """What a stretch of a network moved in all shards, on average; stretch -1 is all but the embeddings."""
    rows = sorted(moves.select(["shard", "moves"]).to_pylist(), key=lambda r: r["shard"])
    if key[1].as_py() < 0:
        total, out = 0.0, None
        for n, values, seen in (pickle.loads(r["moves"]) for r in rows):
            both = [{k: n * x for k, x in d.items()} for d in (values, seen)]
            out = both if out is None else [{k: a[k] + b[k] for k in a} for a, b in zip(out, both)]
            total += n
        got = [{k: (x / total).astype(np.float32) for k, x in d.items()} for d in out]
    else:
        used, times, value, seen = np.zeros(_STRETCH, bool), np.zeros(_STRETCH), None, np.zeros(_STRETCH)
        for at, n, v, s in (pickle.loads(r["moves"]) for r in rows):
            value = np.zeros((_STRETCH, v.shape[1])) if value is None else value
            used[at] = True
            times[at] += n
            value[at] += n[:, None] * v
            seen[at] += n * s
        at = np.flatnonzero(used)
        n = np.maximum(times[at], 1)
        got = (at.astype(np.int16), (value[at] / n[:, None]).astype(np.float32), (seen[at] / n).astype(np.float32))
    return pa.table({"fit": pa.array([key[0].as_py()], pa.int32()), "stretch": pa.array([key[1].as_py()], pa.int32()),
                     "moves": pa.array([pickle.dumps(got)], pa.binary())})


def _fit_all(held: DataFrame, n_shards: int, rows: dict, config: Config) -> dict[int, Network]:
    """A network for each part (fitted on the others) and for all; ``rows``: how many there are of a part and label."""
    states, spark = {}, held.sparkSession
    n = {(k, y): sum(c for (f, t), c in rows.items() if t == y and f != k) for k in range(config.folds + 1) for y in (0, 1)}
    for k in range(config.folds + 1):
        if n[k, 0] and n[k, 1]:
            network = Network(config)
            states[k] = (network, network.memory(), np.zeros(len(network.embed), bool))
    # a single shard is read as often as wanted without averaging
    rounds = max((passes_of(n[k, 0] + n[k, 1], config) for k in states), default=0) if n_shards > 1 else min(1, len(states))

    def job(k: int, turn: int, sent):
        size = n[k, 0] + n[k, 1]
        share, passes = np.float32(n[k, 1]) / np.float32(size), 1 if n_shards > 1 else passes_of(size, config)

        def run(batches):
            texts, shard = _joined(batches, k), TaskContext.get().partitionId() % n_shards
            if not len(texts.y):
                return
            network, memory = pickle.loads(sent.value)
            before, seen = network.embed.copy(), memory["embed"].copy()
            dense = [{name: d[name].copy() for name in network.dense()} for d in (network.dense(), memory)]
            used = learn(network, memory, texts, share, passes, config.seed + shard + 1_000_003 * turn)
            out = [(-1, (len(texts.y), *({name: now[name] - was[name] for name in network.dense()}
                                         for now, was in zip((network.dense(), memory), dense))))]
            for lo in range(0, len(used), _STRETCH):
                at = np.flatnonzero(used[lo:lo + _STRETCH])
                if len(at):
                    out.append((lo // _STRETCH, (at.astype(np.int16), memory["moves"][lo + at], network.embed[lo + at] - before[lo + at],
                                                 memory["embed"][lo + at] - seen[lo + at])))
            yield pa.record_batch([pa.array([k] * len(out), pa.int32()), pa.array([s for s, _ in out], pa.int32()),
                                   pa.array([shard] * len(out), pa.int32()),
                                   pa.array([pickle.dumps(m) for _, m in out], pa.binary())],
                                  names=["fit", "stretch", "shard", "moves"])

        return held.mapInArrow(T.tidy(run), "fit int, stretch int, shard int, moves binary")

    for turn in range(rounds):
        turns = [k for k in states if n_shards == 1 or turn < passes_of(n[k, 0] + n[k, 1], config)]
        sent = {k: spark.sparkContext.broadcast(pickle.dumps(states[k][:2])) for k in turns}     # a fixed size, whatever the input
        moves = reduce(DataFrame.unionByName, [job(k, turn, sent[k]) for k in turns])
        with _setting(spark, "spark.sql.unionOutputPartitioning", "false"):    # a task for each network and shard
            found = moves.groupBy("fit", "stretch").applyInArrow(T.tidy_group(_moved), "fit int, stretch int, moves binary")
            for r in found.toLocalIterator():
                network, memory, used = states[r["fit"]]
                if r["stretch"] < 0:
                    for now, by in zip((network.dense(), memory), pickle.loads(r["moves"])):
                        for name, x in by.items():
                            now[name] += x
                else:
                    at, value, seen = pickle.loads(r["moves"])
                    at = at + np.int64(r["stretch"] * _STRETCH)
                    network.embed[at] += value
                    memory["embed"][at] += seen
                    used[at] = True
        for b in sent.values():
            b.destroy()
    for network, _, used in states.values():
        network.embed[~used] = 0
    return {k: network for k, (network, _, _) in states.items()}


def _word_shares(held: DataFrame, languages: list[str], config: Config) -> np.ndarray:
    """[buckets, languages]: the logarithm of each word's share of a language's words."""
    def count(batches):
        counts = np.zeros((len(languages), config.buckets), np.int64)
        for b in batches:
            texts = _texts(b)
            langs = np.array([languages.index(x or "") if (x or "") in languages else -1 for x in b.column(2).to_pylist()], int)
            owner = np.repeat(langs, np.diff(texts.first))
            for k in range(len(languages)):
                counts[k] += np.bincount(texts.words[owner == k, 0], minlength=config.buckets)
        lang, bucket = np.nonzero(counts)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])],
                              names=["lang", "bucket", "n"])

    counts = np.ones((config.buckets, len(languages)), np.float32)
    found = held.mapInArrow(T.tidy(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    return _log_shares(counts)


def _calibrated(held: DataFrame, model: Model, judges: dict[int, Network], config: Config) -> Model:
    """The model with thresholds from every row's logit by the network that has not seen it."""
    spark = held.sparkSession
    sent = {k: spark.sparkContext.broadcast(pickle.dumps(network)) for k, network in judges.items()}
    guesser = spark.sparkContext.broadcast(pickle.dumps(Model(None, model.languages, model.words)))

    def run(batches):
        guesses, networks = pickle.loads(guesser.value), {}
        for b in batches:
            texts, fold, found = _texts(b), b.column(0).to_numpy(), []
            for k in sent:
                rows = np.flatnonzero(fold == k)
                if len(rows) and k not in networks:
                    networks[k] = pickle.loads(sent[k].value)
                for part in _blocks(len(rows), config):
                    ids, first = texts.take(rows[part], config)
                    found.append(np.stack([guesses.guess(ids, first), _cells(networks[k].logits(ids, first)),
                                           texts.y[rows[part]].astype(np.int64)]))
            if found:
                keys, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
                yield pa.record_batch([pa.array(x.astype(np.int32)) for x in keys] + [pa.array(n.astype(np.int64))],
                                      names=["guess", "cell", "toxic", "n"])

    # no more rows than the grid has places for each language and label
    found = (held.mapInArrow(T.tidy(run), "guess int, cell int, toxic int, n long").groupBy("guess", "cell", "toxic")
             .agg(F.sum("n").alias("n")).orderBy("guess", "cell", "toxic").toArrow())
    for b in (guesser, *sent.values()):
        b.destroy()
    return with_cuts(model, *(found[c].to_numpy() for c in ("guess", "cell", "toxic", "n")), config)


def train(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> bytes:
    """A pickled ``Model`` fitted on every labelled row; docs need doc_id, text and lang, labels doc_id and toxic."""
    held, n_shards = shards(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")),
                            labels.select("doc_id", "toxic"), config)
    held = held.persist(StorageLevel.DISK_ONLY)
    try:
        with _setting(docs.sparkSession, "spark.sql.inMemoryColumnarStorage.batchSize", str(_CACHED_ROWS)):
            n = {(r["fold"], r["toxic"]): r["n"] for r in held.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
        networks = _fit_all(held, n_shards, n, config)
        network = networks.pop(config.folds, None)
        if network is None:
            return pickle.dumps(Model(None))
        top = (held.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), "lang").limit(config.languages).collect())
        languages = sorted(r["lang"] for r in top)
        model = Model(network, languages, _word_shares(held, languages, config))
        return pickle.dumps(_calibrated(held, model, networks, config))
    finally:
        held.unpersist()


def score(docs: DataFrame, model: bytes, config: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)      # a fixed size, whatever the input

    def run(batches):
        m = pickle.loads(sent.value)
        for part, data, offsets in T.doc_batches(batches):
            s = m.scores(*word_ids(data, offsets, config))
            yield pa.record_batch([part.column(0), pa.array(s, pa.float64()),
                                   pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())],
                                  names=["doc_id", "score", "predicted"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(T.tidy(run), f"doc_id {kind}, score double, predicted int")


def reject(docs: DataFrame, model: bytes, config: Config = Config(), text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = pickle.loads(sent.value)
        for part, data, offsets in T.doc_batches(batches, text):
            keep = m.scores(*word_ids(data, offsets, config)) < THRESHOLD
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(T.tidy(run), docs.schema)
