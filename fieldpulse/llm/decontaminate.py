"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

Finds short test items inside long documents.  Texts are sets of shingles of
``width`` words (letters and digits, lower case).  An item is contained when
the share of its shingles that a document holds reaches ``percent``.

Items are partitioned by size (powers of two).  In each partition an item's
sketch is its shingles with the smallest hashes, as many as the partition's
largest size can miss, and one more: a document that holds ``percent`` % of the
item must hold one of them, so the search misses nothing.  (The sketch is kept
on the items' side only: a document's own MinHash would hardly ever hold a
short passage.)  Every shingle of every whole document is tried against the
sketches; the documents found are then verified by exact shingle containment
on the words themselves.

The sketches are broadcast when there are at most ``SKETCH_ROWS`` of them, the
items' shingles when they weigh at most ``SHINGLE_BYTES`` (both counted first);
beyond that Spark joins by shuffle.

An item with fewer words than the width is one shingle, its whole sequence of
words; for each such length that occurs among the items, the documents' windows
of that length are tried and verified as well.

Defined results: a short item is contained where its words stand one after
another, however long the document; null texts and texts without
words hold nothing and are held by nothing; documents and items are known by
their id, rows that repeat an id count as one (the union of their shingles);
rows with a null id are not searched and stay in ``remove``; other columns are
not read, and all kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import _text as T

SKETCH_ROWS = 1 << 20
SHINGLE_BYTES, ROW_BYTES = 64 << 20, 64         # of the items' shingles that are broadcast; what a row costs besides
_SPLIT = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def _with_words(rows: DataFrame) -> DataFrame:
    """(id, words): a column of its own, so that the split runs once for all its uses."""
    return rows.select("id", F.explode(F.array(_words(F.col("text")))).alias("words"))


def _windows(width: int, one, shorter: Sequence[int] = ()) -> Column:
    """An array of ``one(start, width)`` for each window of ``words`` (the whole sequence if it is shorter).

    With ``shorter``, also of the windows of these numbers of words.
    """
    n = F.size("words")

    def each(m: int, starts: Column) -> Column:
        return F.transform(starts, lambda i: one(i, m))

    whole = each(width, F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))))
    also = [each(m, F.slice(F.sequence(F.lit(0), n), 1, F.greatest(n - m + 1, F.lit(0)))) for m in shorter]
    return F.when(n > 0, F.concat(whole, *also) if also else whole)


def _hashes(width: int, shorter: Sequence[int] = ()) -> Column:
    # words beyond the end are null, which xxhash64 skips: a short item has the hash of its window in a document
    return _windows(width, lambda i, m: F.xxhash64(*(F.get("words", i + j) for j in range(m))), shorter)


def _shingles(width: int, shorter: Sequence[int] = ()) -> Column:
    return _windows(width, lambda i, m: F.concat_ws(" ", F.slice("words", i + 1, F.lit(m))), shorter)


def _short_lengths(items: DataFrame, width: int) -> list[int]:
    """Which numbers of words below the width items have (at most ``width`` - 1 rows)."""
    lengths = _with_words(items).select(F.size("words").alias("n")).filter((F.col("n") > 0) & (F.col("n") < width))
    return sorted(r["n"] for r in lengths.distinct().collect())


def _source(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    return (rows.filter(F.col(row_id).isNotNull() & F.col(text).isNotNull())
            .select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")))


def sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(hash, item_id): for each item the smallest hashes that its size partition asks for."""
    hashes = (_with_words(items).select("id", F.explode(_hashes(width)).alias("hash")).distinct())
    sized = hashes.join(hashes.groupBy("id").agg(F.count("*").alias("n")), "id")
    # sizes from 2^k to 2^(k + 1) - 1 are one partition; its largest item can miss (100 - percent) % of its shingles
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    length = F.floor(largest * (100 - percent) / 100) + 1
    order = Window.partitionBy("id").orderBy("hash")               # one item's shingles
    return (sized.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= length)
            .select("hash", F.col("id").alias("item_id")))


def find(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
         text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item that a document contains."""
    source, tests = _source(docs, doc_id, text), _source(items, item_id, item_text)
    sketch = sketches(tests, width, percent)
    few = sketch.count() <= SKETCH_ROWS
    shorter = _short_lengths(tests, width)
    tried = _with_words(source).select(F.col("id").alias("doc_id"), F.explode(_hashes(width, shorter)).alias("hash"))
    # used twice: written, or every document would be tried twice
    path = scratch_path(docs.sparkSession, "suspects")
    (tried.join(F.broadcast(sketch) if few else sketch, "hash").select("doc_id", "item_id").distinct()
     .write.parquet(path))
    candidates = docs.sparkSession.read.parquet(path)

    exact = _with_words(tests).select(F.col("id").alias("item_id"), F.explode(_shingles(width)).alias("shingle")).distinct()
    # the texts of the items' shingles, not the sketch's rows, are what is broadcast here
    weight = exact.agg(F.coalesce(F.sum(F.octet_length("shingle") + ROW_BYTES), F.lit(0))).first()[0]
    light = weight <= SHINGLE_BYTES
    sizes = exact.groupBy("item_id").agg(F.count("*").alias("n_item"))
    suspects = source.join(candidates.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    held = _with_words(suspects).select(F.col("id").alias("doc_id"),
                                        F.explode(F.array_distinct(_shingles(width, shorter))).alias("shingle"))
    shared = (held.join(F.broadcast(exact) if light else exact, "shingle")
              .groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared")))
    return (shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
            .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
            .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")))


def remove(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
           text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that contain an item; all columns stay as they are."""
    leak = T.free_name(docs.columns, "_leak")
    leaks = (find(docs, items, width, percent, doc_id, text, item_id, item_text)
             .select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(leaks, F.col(doc_id) == F.col(leak), "left_anti")
