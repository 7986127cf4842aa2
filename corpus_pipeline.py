"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

    toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept.  All but the last return the columns of ``docs``; the last
returns each document's ids and their digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity_cnn
from fieldpulse.llm._text import free_name
from fieldpulse.session import prepare, scratch_path

#: no SQL can express the trained classifier; tests hold run() against a brute-force version
ORACLE_SQL = None

#: labels of documents in this part of four (by crc32 of the id) are not learned from
HELD_OUT = 2
MIN_DOCS = 10                # a line found in so many documents goes
WIDTH, PERCENT = 5, 80       # word shingles and similarity of the near-duplicate and benchmark stages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned from this input's labelled rows, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity_cnn.train(docs, labels.filter(fold != HELD_OUT))
    return toxicity_cnn.reject(docs, model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that stand in ``MIN_DOCS`` documents; n_chars follows the text."""
    index = line_dedup.LineIndex(spark, min_docs=MIN_DOCS).insert(docs)
    lines, dropped = free_name(docs.columns, "_lines"), free_name(docs.columns, "_dropped")
    out = index.drop_lines(docs, n_lines=lines, n_dropped=dropped)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard_join.one_of_each(docs, WIDTH, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of ``benchmark``."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WIDTH, PERCENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document that is left."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    path = scratch_path(prepare(spark), "pipeline")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
