"""Lag of a stream from the engine's own bookkeeping: committed and newest offsets.

A checkpoint says what has been committed (``offsets`` and ``commits``, and for
a file source the files of each entry of its log); the source says what there
is.  So the lag can be read while a query runs, when it is stopped, and from
another process; a running query's progress tells the same for a topic.
Everything has the columns of a consumer-group listing, so that
``recovery.group_lag`` sums it up.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "topic string, partition int, current_offset long, log_end_offset long, lag long"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): the lines of a log folder whose entries are files named by their number."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), "value")


def _last_committed(spark: SparkSession, checkpoint: str) -> int:
    done = _entries(spark, f"{checkpoint}/commits").agg(F.max(F.col("name").try_cast("long"))).first()[0]
    return -1 if done is None else int(done)


def committed_offsets(spark: SparkSession, checkpoint: str) -> list[str]:
    """The offset of each source after the newest committed micro-batch, as the engine wrote it (JSON)."""
    last = _last_committed(spark, checkpoint)
    if last < 0:
        return []
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{last}").collect()]      # a line for each source
    return lines[2:]                                            # after the format's version and the metadata


def _same_place(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def committed_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """(path): the files that a file source's committed micro-batches have read."""
    offsets = committed_offsets(spark, checkpoint)
    log = json.loads(offsets[source])["logOffset"] if len(offsets) > source else -1
    entry = F.from_json("value", "path string, batchId long")
    lines = _entries(spark, f"{checkpoint}/sources/{source}").where(F.col("value").startswith("{")).select(entry.alias("e"))
    return lines.where(F.col("e.batchId") <= log).select(_same_place(F.col("e.path")).alias("path")).distinct()


def file_lag(spark: SparkSession, checkpoint: str, folder: str, source: int = 0) -> DataFrame:
    """One row like a consumer-group listing's, counted in files: read, there, and not read yet."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        _same_place(F.col("path")).alias("path"))
    read = committed_files(spark, checkpoint, source).withColumn("is_read", F.lit(True))
    both = there.join(read, "path", "left")
    return both.agg(F.count("is_read").alias("current_offset"), F.count(F.lit(1)).alias("log_end_offset")).select(
        F.lit(folder).alias("topic"), F.lit(0).alias("partition"), "current_offset", "log_end_offset",
        (F.col("log_end_offset") - F.col("current_offset")).alias("lag"))


def _as_json(offset):
    return json.loads(offset) if isinstance(offset, str) else offset


def progress_lag(spark: SparkSession, progress) -> DataFrame:
    """The lag of each topic partition from a query's progress (``query.lastProgress``); none before the first."""
    rows = []
    for source in (_as_json(getattr(progress, "json", progress)) or {}).get("sources", []) if progress else []:
        done, newest = (_as_json(source.get(k)) or {} for k in ("endOffset", "latestOffset"))
        if not isinstance(done, dict):                          # a source with a plain number
            done, newest = {source["description"]: {"0": done}}, {source["description"]: {"0": newest or done}}
        for topic, parts in done.items():
            if isinstance(parts, dict):
                for p, at in parts.items():
                    end = max((newest.get(topic) or {}).get(p, at), at)
                    rows.append((topic, int(p), int(at), int(end), int(end - at)))
    return spark.createDataFrame(rows, LISTING)


def window_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(window_start, window_end): the windows that a Spark-state window query still holds open."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.window.start").cast("timestamp_ntz").alias("window_start"),
                        F.col("key.window.end").cast("timestamp_ntz").alias("window_end"))
