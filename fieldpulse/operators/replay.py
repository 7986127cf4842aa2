"""Replay of readings in file order: fixed-size batches and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.operators.ordinal import with_global_ordinal
from fieldpulse.operators.positions import with_file_position
from fieldpulse.schema import REPLAY_BATCH_SIZE, REPLAY_INTERVAL_S


PAGE_ROWS = 100_000          # rows that a top-k may hold in one task


def _batched(numbered: DataFrame, batch_size: int, interval_s: int) -> DataFrame:
    batch = (F.floor((F.col("row_no") - 1) / F.lit(int(batch_size))) + 1).cast("long")
    return numbered.select("*", batch.alias("batch_no"),
                           ((batch - 1) * F.lit(int(interval_s))).cast("long").alias("release_offset_s"))


def replay_files(readings: DataFrame, batch_size: int = REPLAY_BATCH_SIZE, interval_s: int = REPLAY_INTERVAL_S) -> DataFrame:
    """:func:`replay_batches` in the order of the files that ``readings`` was read from; no row is moved."""
    return _batched(with_file_position(readings, "row_no"), batch_size, interval_s)


def replay_batches(readings: DataFrame, order_cols: Sequence[str] = ("arrival_ts", "event_id"),
                   batch_size: int = REPLAY_BATCH_SIZE, interval_s: int = REPLAY_INTERVAL_S) -> DataFrame:
    """Batch number ``floor((row - 1) / size) + 1`` in the order of ``order_cols`` and the
    release offset of each batch (one batch per interval, none after the last).

    This sorts; for files that already are in order use :func:`replay_files`.
    """
    return _batched(with_global_ordinal(readings, order_cols, name="row_no"), batch_size, interval_s)


def batch_slice(readings: DataFrame, skip: int, take: int,
                order_cols: Sequence[str] = ("arrival_ts", "event_id")) -> DataFrame:
    """``Skip(skip).Take(take)`` in the order of ``order_cols`` (in file order: ``positions.file_slice``).

    The first ``skip + take`` rows are taken as a top-k (each task keeps that
    many); a slice that far into the table (``PAGE_ROWS``) is cut from the
    distributed ordinal instead.
    """
    lo, hi = int(skip), int(skip + take)
    if hi <= PAGE_ROWS:
        order = Window.partitionBy(F.lit(0)).orderBy(*order_cols)       # of hi rows
        o = readings.orderBy(*order_cols).limit(hi).withColumn("row_no", F.row_number().over(order).cast("long"))
    else:
        o = with_global_ordinal(readings, order_cols, name="row_no")
    return o.where((F.col("row_no") > F.lit(lo)) & (F.col("row_no") <= F.lit(hi)))
