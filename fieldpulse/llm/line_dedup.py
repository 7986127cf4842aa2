"""Incremental line dedup: sharded cuckoo filters over exact reference-count tables.

State (a folder of Parquet tables, one version per change):

* ``refs``: line key digest (128 bits) -> number of documents that hold the
  line, exact and complete.  Insertions add, deletions subtract, and a key at
  zero leaves the table, so every change can be taken back.
* ``filters``: for each shard of the key space a cuckoo filter (16-bit
  fingerprints, four to a bucket) of the keys that reach the threshold.  A
  change inserts the keys that rise to the threshold and deletes those that
  fall below it, in place; a filter that is full is rebuilt twice as large from
  the table.

A line's key is the line without ASCII white space at both ends, with A-Z in
lower case.  Lines whose key is empty are never dropped.

An index under a given path is opened again where it stands: the newest whole
version counts, one that was not finished is written anew.  Taking back a
document that was not inserted is refused, and leaves the index as it was.

Removing lines: the filters and the exact keys they stand for go to the tasks
when their size, which is counted first, is at most ``BROADCAST_BYTES``; each
line is tried against its shard's filter and only a hit is looked up among the
exact keys.  Beyond that size the lines' digests are joined with the table.
Both ways give the same rows.

Hot lines: keys are counted within a task before they are shuffled (one row
for each key and task at most), so a line found in every document is one small
row from each task.

Defined results: a null or empty text is one empty line, which stays (a null
text stays null); one row
out for one in, repeated rows counted as documents of their own, null ids
allowed; the output keeps all input columns, but for one that has the name of a
count, which the count replaces.  Whole texts are read; memory is bounded by one
Arrow batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import _text as T

BROADCAST_BYTES = 64 << 20
KEYS_PER_SHARD = 1 << 18
_WHITE = b" \t\n\v\f\r"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line of a text."""
    return [x.strip(_WHITE) for x in text.lower().split(b"\n")]      # bytes.lower changes A-Z only


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A set of 64-bit hashes with deletion; false positives about 8 / 65536, no false negatives."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 64, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.84)))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = hashes & mask
        return mark, one, one ^ (T.mix64(mark.astype(np.uint64)) & mask)

    def add(self, hashes: np.ndarray) -> bool:
        """Insert distinct hashes not in the set; False when there was no room (the filter is then void)."""
        mark, one, two = self._places(hashes)
        mask, state = len(self.table) - 1, 1
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist()):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = m
                    break
            else:
                at = b
                for _ in range(self.KICKS):
                    state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                    slot = (state >> 16) % self.SLOTS
                    m, self.table[at, slot] = int(self.table[at, slot]), m
                    at ^= int(T.mix64(np.array([m], np.uint64))[0]) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def remove(self, hashes: np.ndarray) -> None:
        """Delete hashes that are in the set."""
        mark, one, two = self._places(hashes)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist()):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == m)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def blob(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())


def _halves(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two unsigned 64-bit integers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high >> np.uint64(1)).astype(np.int64) % shards


def _counts(docs: DataFrame, text: str, sign: int) -> DataFrame:
    """(h, l, n): how many of these documents hold each key; summed within a task first."""
    def run(batches):
        for part, data, offsets in T.doc_batches(batches):
            raw, at = data.tobytes(), offsets.tolist()
            found: dict[bytes, int] = {}
            for a, b in zip(at[:-1], at[1:]):
                for key in set(line_keys(raw[a:b])):
                    if key:
                        found[key] = found.get(key, 0) + 1
            both = _halves([digest(k) for k in found]).view(np.int64)
            yield pa.record_batch([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])),
                                   pa.array(np.fromiter(found.values(), np.int64, len(found)) * sign)], names=["h", "l", "n"])

    src = docs.select(F.col(text).cast("string").alias("text"))
    return src.mapInArrow(T.tidy(run), "h long, l long, n long")


class LineIndex:
    """Reference counts and filters of the lines of a document set, under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10,
                 keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.min_docs, self.keys_per_shard = spark, min_docs, keys_per_shard
        self.path, self.version = path or scratch_path(spark, "line-index"), 0
        if path:
            self._open()

    def _open(self) -> None:
        """Go on from the newest whole version that the folder holds; one that was not finished is written anew."""
        try:
            whole = self.spark.read.parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return
        newest = whole.agg(F.max_by(F.struct("version", "min_docs"), "version").alias("v")).first().v
        if newest.min_docs != self.min_docs:
            raise ValueError(f"this index drops lines of {newest.min_docs} documents, not {self.min_docs}")
        self.version = int(newest.version)

    def _table(self, kind: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version if version is None else version}/{kind}")

    def refs(self) -> DataFrame:
        """(h, l, n) of every line key."""
        return self._table("refs")

    def filters(self) -> DataFrame:
        """(shard, shards, keys, filter binary)."""
        return self._table("filters")

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._change(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take back documents that were inserted (their texts as they were then)."""
        return self._change(docs, text, -1)

    def _change(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        parts = [_counts(docs, text, sign).withColumn("old", F.lit(0).cast("long"))]
        if self.version:
            parts.append(self.refs().withColumn("old", F.col("n")))
        new, limit = self.version + 1, self.min_docs
        out = f"{self.path}/v{new}"
        # range-free hash layout by key: the sum's own exchange is the only shuffle
        (reduce(DataFrame.unionByName, parts).groupBy("h", "l").agg(F.sum("n").alias("n"), F.sum("old").alias("old"))
         .write.mode("overwrite").parquet(f"{out}/changed"))
        changed = self.spark.read.parquet(f"{out}/changed")
        if sign < 0 and not changed.filter("n < 0").isEmpty():
            raise ValueError("a document is taken back that was not inserted")
        changed.filter("n > 0").select("h", "l", "n").write.mode("overwrite").parquet(f"{out}/refs")
        hot = changed.filter((F.col("n") >= limit) | (F.col("old") >= limit))
        held = hot.filter(F.col("n") >= limit).count()
        shards = max(1, -(-held // self.keys_per_shard))
        old = None
        if self.version:
            first = self.filters().select("shards").first()
            shards, old = (first[0], self.filters()) if first and first[0] >= shards else (shards, None)
        self._filters(hot, shards, old).write.mode("overwrite").parquet(f"{out}/filters")
        (self.spark.createDataFrame([(new, limit)], "version long, min_docs long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/versions/v={new}"))
        self.version = new
        return self

    def _filters(self, hot: DataFrame, shards: int, old: DataFrame | None) -> DataFrame:
        limit, slack = self.min_docs, 2

        def build(key, keys: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            h = keys["h"].to_numpy(np.int64).view(np.uint64)
            now, then = keys["n"].to_numpy() >= limit, keys["old"].to_numpy() >= limit
            made = None
            if len(before):
                made = CuckooFilter.load(before["filter"].iloc[0])
                made.remove(h[then & ~now])
                if not made.add(h[now & ~then]):
                    made = None
            size = max(64, slack * int(now.sum()))
            while made is None:
                made = CuckooFilter(size)
                if not made.add(h[now]):
                    made, size = None, 2 * size
            return pd.DataFrame({"shard": [int(key[0])], "shards": [shards], "keys": [int(now.sum())],
                                 "filter": [made.blob()]})

        # the same rule as shard_of, on signed longs: bits 1 to 63
        keyed = hot.withColumn("shard", F.expr(f"shiftrightunsigned(h, 1) % {shards}"))
        before = old if old is not None else self.spark.createDataFrame([], "shard long, shards long, keys long, filter binary")
        return (keyed.groupBy("shard").cogroup(before.groupBy("shard"))
                .applyInPandas(build, "shard long, shards long, keys long, filter binary"))

    def hot_keys(self) -> DataFrame:
        return self.refs().filter(F.col("n") >= self.min_docs).select("h", "l")

    def drop_lines(self, docs: DataFrame, text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped",
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with the remaining lines as text, and how many lines there were and went."""
        keys = self.hot_keys().count()
        size = self.filters().agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        if 16 * keys + size <= broadcast_bytes:
            return self._drop_local(docs, text, n_lines, n_dropped)
        return self._drop_joined(docs, text, n_lines, n_dropped)

    def _drop_local(self, docs: DataFrame, text: str, n_lines: str, n_dropped: str) -> DataFrame:
        exact = self.hot_keys().toArrow()
        pairs = np.empty(exact.num_rows, [("h", "<u8"), ("l", "<u8")])
        pairs["h"] = exact["h"].to_numpy().view(np.uint64)
        pairs["l"] = exact["l"].to_numpy().view(np.uint64)
        rows = self.filters().select("shard", "shards", "filter").collect()      # bounded by broadcast_bytes
        sent = self.spark.sparkContext.broadcast((np.sort(pairs).tobytes(), [tuple(r) for r in rows]))

        def run(batches):
            blob, filters = sent.value
            known = frozenset(blob[i:i + 16] for i in range(0, len(blob), 16))
            shards = filters[0][1] if filters else 1
            held = {s: CuckooFilter.load(f) for s, _, f in filters}

            def hot(keys: list[bytes]) -> set[bytes]:
                """Of these keys, those to drop: by the filters, then among the exact keys."""
                if not held or not keys:
                    return set()
                found = [digest(k) for k in keys]
                high = _halves(found)[:, 0]
                shard = shard_of(high, shards)
                positive = np.zeros(len(keys), bool)
                for s in np.unique(shard).tolist():
                    if s in held:
                        at = np.flatnonzero(shard == s)
                        positive[at] = held[s].has(high[at])
                return {keys[i] for i in np.flatnonzero(positive) if found[i] in known}

            def of_rows(part, per_doc):
                common = hot(list({k for keys in per_doc for k in keys if k}))
                return [common] * len(per_doc)

            yield from _rewrite(batches, text, of_rows)

        return _with_counts(docs, run, n_lines, n_dropped)

    def _drop_joined(self, docs: DataFrame, text: str, n_lines: str, n_dropped: str) -> DataFrame:
        """Without a bound on the keys: the digests of each text's lines are joined with the table.

        Equal texts share one key of the text, so copies are looked up once.
        """
        own, named, hot_lines = (T.free_name(docs.columns, n) for n in ("_lines", "_text_key", "_hot"))
        tagged = docs.withColumn(own, F.col(text).cast("string"))
        tagged = tagged.withColumn(named, F.unhex(F.md5(own)))

        def keys(batches):
            for part, data, offsets in T.doc_batches(batches, "_lines"):
                raw, at = data.tobytes(), offsets.tolist()
                row, found = [], []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    for key in {k for k in line_keys(raw[a:b]) if k}:
                        row.append(i)
                        found.append(digest(key))
                both = _halves(found).view(np.int64)
                yield pa.record_batch([part.column(0).take(pa.array(row, pa.int64())),
                                       pa.array(np.ascontiguousarray(both[:, 0])),
                                       pa.array(np.ascontiguousarray(both[:, 1]))], names=["_text_key", "h", "l"])

        lines = (tagged.select(F.col(named).alias("_text_key"), F.col(own).alias("_lines")).filter("_text_key is not null")
                 .mapInArrow(T.tidy(keys), "_text_key binary, h long, l long").distinct())
        # one row for each text: its own hot lines, as many as it has lines at most
        found = (lines.join(self.hot_keys(), ["h", "l"]).groupBy(F.col("_text_key").alias(named))
                 .agg(F.collect_list(F.struct("h", "l")).alias(hot_lines)))

        def of_rows(part, per_doc):
            mine = part.column(part.schema.get_field_index(hot_lines)).to_pylist()
            out = []
            for keys_of, held in zip(per_doc, mine):
                known = {np.array([x["h"], x["l"]], np.int64).tobytes() for x in held or ()}
                out.append({k for k in set(keys_of) if k and digest(k) in known} if known else frozenset())
            return out

        joined = tagged.join(found, named, "left").select(*docs.columns, hot_lines)
        return _with_counts(joined, lambda batches: _rewrite(batches, text, of_rows), n_lines, n_dropped, leave=(hot_lines,))


def _rewrite(batches, text: str, hot):
    """Batches with the text's remaining lines, and the two counts appended.

    ``hot(rows, keys of each row's lines)`` gives the set of keys that go, for each row.
    """
    for batch in batches:
        at_text = batch.schema.get_field_index(text)
        for part, data, offsets in T.doc_batches([batch], text):
            raw, at = data.tobytes(), offsets.tolist()
            per_doc = [line_keys(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            kept, total, gone = [], [], []
            for (a, b), keys, drop in zip(zip(at[:-1], at[1:]), per_doc, hot(part, per_doc)):
                out = raw[a:b]
                n = 0
                if drop and not drop.isdisjoint(keys):
                    lines = out.split(b"\n")
                    stay = [x for x, k in zip(lines, keys) if k not in drop]
                    n, out = len(lines) - len(stay), b"\n".join(stay)
                kept.append(out)
                total.append(len(keys))
                gone.append(n)
            columns = list(part.columns)
            null = np.asarray(part.column(at_text).is_null())
            new = pa.array(kept, pa.binary(), mask=null).cast(pa.string())
            columns[at_text] = new.cast(part.schema.field(at_text).type)
            lines, dropped = T.free_name(part.schema.names, "_n_lines"), T.free_name(part.schema.names, "_n_dropped")
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                  names=[*part.schema.names, lines, dropped])


def _with_counts(docs: DataFrame, run, n_lines: str, n_dropped: str, leave: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` through ``run`` without the columns ``leave``; the counts stand last, under the given names.

    A column of ``docs`` that has one of these names gives way to the count.
    """
    from pyspark.sql.types import LongType, StructType
    lines, dropped = T.free_name(docs.columns, "_n_lines"), T.free_name(docs.columns, "_n_dropped")
    schema = StructType([*docs.schema.fields]).add(lines, LongType()).add(dropped, LongType())
    stay = [c for c in docs.columns if c not in (*leave, n_lines, n_dropped)]
    return docs.mapInArrow(T.tidy(run), schema).select(*stay, F.col(lines).alias(n_lines), F.col(dropped).alias(n_dropped))
