"""Language identification by hierarchical discrimination.

First the language family is predicted (one linear SVM per family against the
rest), then one-versus-one linear SVMs separate the related languages within
it: each pair votes, ties go to the larger sum of margins.  Features are
hashed byte bigrams and trigrams of the lower-cased text, as square roots of
their relative frequencies.  The machines are trained in numpy by dual
coordinate descent on a bounded sample of labelled rows (``Config.per_language``
rows of each language, drawn by a hash of the id, whole texts).

Families are given by language code (``FAMILIES``); a code not in the table is
a family of its own.  The language column, the source and the id are never
inputs of a prediction.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without labelled rows every text is ``und``; one row out for one in, repeated
rows and null ids included; columns other than the id and text are neither
read nor returned.  Whole texts are read, in blocks of bytes, so one very long
text needs no more memory than its own bytes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: language families by ISO 639-1 code
FAMILIES: dict[str, str] = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv su mg",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"


@dataclass(frozen=True)
class Config:
    features: int = 1 << 13
    per_language: int = 500          # bound of the training sample, for each language
    cost: float = 4.0
    epochs: int = 12
    seed: int = 11
    block: int = 1 << 20             # bytes counted at a time
    block_docs: int = 128


def counts(data: np.ndarray, offsets: np.ndarray, features: int, block: int) -> np.ndarray:
    """[texts, features]: hashed byte bigrams and trigrams within each text."""
    n = len(offsets) - 1
    out = np.zeros(n * features, np.int64)
    text = T.LOWER[data]
    for lo in range(0, len(text), block):
        hi = min(len(text), lo + block)
        part = text[lo:min(len(text), hi + 2)].astype(np.uint32)
        owner = np.searchsorted(offsets, np.arange(lo, lo + len(part)), "right") - 1
        for width in (2, 3):
            m = min(hi - lo, len(part) - width + 1)
            if m <= 0:
                continue
            code = part[:m] | (part[1:1 + m] << np.uint32(8))
            if width == 3:
                code = code | (part[2:2 + m] << np.uint32(16)) | np.uint32(1 << 24)
            slot = ((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(features)
            inside = owner[:m] == owner[width - 1:width - 1 + m]
            out += np.bincount((owner[:m] * features + slot)[inside], minlength=len(out))
    return out.reshape(n, features)


def scaled(table: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies, with a constant feature."""
    total = np.maximum(table.sum(1, keepdims=True), 1)
    return np.hstack([np.sqrt(table / total), np.ones((len(table), 1))]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, config: Config) -> np.ndarray:
    """Weights of a linear SVM (squared hinge loss, classes weighted alike) by dual coordinate descent."""
    rng = np.random.default_rng(config.seed)
    cost = config.cost * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    soft = 1 / (2 * cost)
    q = (x * x).sum(1) + soft
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    for _ in range(config.epochs):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * float(x[i] @ w) - 1 + alpha[i] * soft[i]) / q[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
    return w


class Model:
    """The family machines and, within each family, one machine for each pair."""

    def __init__(self, x: np.ndarray, langs: list[str], config: Config = Config()):
        self.features = config.features
        lang = np.array(langs)
        family = np.array([FAMILY_OF.get(v, v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: sorted(set(lang[family == f])) for f in self.families}
        machines, self.pairs = [], {}
        if len(self.families) > 1:
            machines += [svm(x, np.where(family == f, 1.0, -1.0), config) for f in self.families]
        self.tops = len(machines)
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (lang == a) | (lang == b)
                self.pairs[f, a, b] = len(machines)
                machines.append(svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0), config))
        self.weights = np.array(machines, np.float32).T if machines else np.zeros((config.features + 1, 0), np.float32)

    def predict(self, table: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for each row of counts."""
        margins = scaled(table) @ self.weights
        sure = 1 / (1 + np.exp(-np.clip(4.0 * margins, -40, 40)))
        out = []
        for m, p in zip(margins, sure):
            f, score = self.families[0], 1.0
            if self.tops:
                k = int(np.argmax(m[:self.tops]))
                f, score = self.families[k], float(p[k] / p[:self.tops].sum())
            votes = {v: [0, 0.0, []] for v in self.members[f]}
            for a, b in combinations(self.members[f], 2):
                i = self.pairs[f, a, b]
                for v, sign, q in ((a, 1, p[i]), (b, -1, 1 - p[i])):
                    votes[v][0] += sign * m[i] > 0
                    votes[v][1] += sign * float(m[i])
                    votes[v][2].append(float(q))
            best = max(self.members[f], key=lambda v: (votes[v][0], votes[v][1], v))
            won = votes[best][2]
            out.append((best, min(1.0, max(0.0, score * (sum(won) / len(won) if won else 1.0)))))
        return out


def sample(docs: DataFrame, config: Config) -> DataFrame:
    """(lang, text): a bounded number of rows of each language, the ones with the smallest hashes of their ids."""
    known = docs.filter("text is not null and lang is not null").withColumn(
        "draw", F.xxhash64(F.col("doc_id").cast("string"), F.lit(config.seed)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # one row a language
    below = F.lit(False)
    for lang, n in sorted(sizes.items()):
        share = min(1.0, 1.2 * config.per_language / n)
        mine = F.col("lang") == F.lit(lang)
        below = below | ((mine & (F.col("draw") < int((2 * share - 1) * (1 << 63)))) if share < 1 else mine)
    return known.filter(below).select("lang", "text", "draw")


def train(docs: DataFrame, config: Config = Config()) -> bytes | None:
    """A pickled ``Model`` from the rows' text and lang; None without usable rows."""
    def features(batches):
        for part, data, offsets in T.doc_batches(batches):
            for i in range(0, part.num_rows, config.block_docs):
                j = min(part.num_rows, i + config.block_docs)
                table = counts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], config.features, config.block)
                rows = []
                for r in table:
                    nz = np.flatnonzero(r)
                    rows.append(np.concatenate([nz.astype(np.uint32), r[nz].astype(np.uint32)]).tobytes())
                yield pa.record_batch([part.column(0).slice(i, j - i), part.column(2).slice(i, j - i),
                                       pa.array(rows, pa.binary())], names=["lang", "draw", "bag"])

    def learn(batches):
        taken: dict[str, int] = {}
        x, langs = [], []
        for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["lang"], r["draw"], r["bag"])):
            if taken.get(r["lang"], 0) < config.per_language and r["bag"]:
                taken[r["lang"]] = taken.get(r["lang"], 0) + 1
                bag = np.frombuffer(r["bag"], np.uint32).reshape(2, -1)
                row = np.zeros(config.features, np.int64)
                row[bag[0]] = bag[1]
                x.append(scaled(row[None])[0])
                langs.append(r["lang"])
        model = pickle.dumps(Model(np.array(x), langs, config)) if x else None
        yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    bags = sample(src, config).mapInArrow(features, "lang string, draw long, bag binary")
    first = bags.repartition(1).mapInArrow(learn, "model binary").first()          # the bounded sample only
    return first[0] if first else None


def predict(docs: DataFrame, model: bytes | None, config: Config = Config(), doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)        # a fixed size for each pair of related languages

    def run(batches):
        import regex
        letter = regex.compile(r"\p{L}")
        m = pickle.loads(sent.value) if sent.value else None
        for part, data, offsets in T.doc_batches(batches):
            for i in range(0, part.num_rows, config.block_docs):
                rows = part.slice(i, config.block_docs)
                j = i + rows.num_rows
                out = [(UNDETERMINED, 0.0)] * rows.num_rows
                some = [k for k, t in enumerate(rows.column(1).to_pylist()) if t and letter.search(t)]
                if m is not None and some:
                    table = counts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], m.features, config.block)
                    for k, got in zip(some, m.predict(table[some])):
                        out[k] = got
                yield pa.record_batch([rows.column(0), pa.array([o[0] for o in out], pa.string()),
                                       pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
