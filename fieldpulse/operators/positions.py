"""Positions in file order, without sorting or moving a row.

A row's place in its file comes from the scan itself (Parquet's row index; for
text formats the place within its block).  Row counts of the files (or blocks)
in front of it, a table of one row each, are added up and joined back.  The
rows are neither shuffled nor checkpointed.

Files are in the order of their folder, then of a writer's part number
(``part-00012``), then of their name; rows of a text file in the order of its
blocks.  Read whole files: a filter belongs after the positions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: files whose counts are broadcast (some 40 MB); beyond, the counts are joined by shuffle
MOST_FILES = 100_000


def _file_order(path: Column) -> list[Column]:
    return [F.regexp_extract(path, r"^(.*/)", 1), F.regexp_extract(path, r"part-([0-9]+)[^/]*$", 1).try_cast("long"), path]


def _placed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with (_file, _block, _at), and the first place and the row count of each block."""
    try:
        rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"),
                            F.col("_metadata.row_index").alias("_at"))
        blocks = rows.groupBy("_file", "_block").agg(F.lit(0).cast("long").alias("_first"), (F.max("_at") + 1).alias("_n"))
    except AnalysisException:                          # a text format has no row index: a block is read in one go
        rows = files.select("*", F.col("_metadata.file_path").alias("_file"),
                            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
        blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return rows, blocks


def _with_before(blocks: DataFrame) -> DataFrame:
    """Rows in front of each block and in all; one row a block, so one task holds them."""
    order = Window.orderBy(*_file_order(F.col("_file")), "_block")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("_file", "_block", "_first", "_n", F.coalesce(before, F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))


def with_file_position(files: DataFrame, name: str = "position", with_total: bool = False) -> DataFrame:
    """Add each row's 1-based position in file order; ``files`` is a frame as read (it still has ``_metadata``).

    ``with_total`` also adds ``<name>_total``, the number of rows.
    """
    rows, blocks = _placed(files)
    blocks = _with_before(blocks).drop("_n")
    if len(files.inputFiles()) <= MOST_FILES:
        blocks = F.broadcast(blocks)
    out = rows.join(blocks, ["_file", "_block"])
    out = out.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
    if with_total:
        out = out.withColumnRenamed("_total", f"{name}_total")
    return out.drop("_file", "_block", "_at", "_first", "_before", "_total")


def file_slice(files: DataFrame, skip: int, take: int, name: str = "position") -> DataFrame:
    """The ``take`` rows after the first ``skip`` in file order; only files that hold some of them are read for it."""
    _, blocks = _placed(files)
    lo, hi = int(skip), int(skip) + int(take)
    held = (_with_before(blocks).groupBy("_file").agg(F.min("_before").alias("before"), F.sum("_n").alias("n"))
            .where((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)).collect())      # at most ``take`` files
    if not held:
        return with_file_position(files, name).where(F.lit(False))
    wanted = files.where(F.col("_metadata.file_path").isin([r._file for r in held]))
    out = with_file_position(wanted, name)
    shift = min(r.before for r in held)
    out = out.withColumn(name, F.col(name) + F.lit(shift))
    return out.where((F.col(name) > lo) & (F.col(name) <= hi))
