"""Service counters of the analytics and storage consumers, as aggregates.

A live service keeps these as in-memory counters; here they are one-row
(or per-group) aggregates over the message frame, so they can be computed
over any slice of the stream and re-computed after a restart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.timefmt import iso_format
from fieldpulse.operators.ordinal import with_global_ordinal
from fieldpulse.operators.positions import with_file_position
from fieldpulse.schema import PROGRESS_EVERY


def _grouped(df: DataFrame, group_cols: Sequence[str]):
    return df.groupBy(*group_cols) if group_cols else df.groupBy()


def analytics_counters(view: DataFrame, alert_col: str, order_cols: Sequence[str],
                       group_cols: Sequence[str] = (), published_col: str = "a_published_at",
                       latency_col: str = "e2e_latency_ms", alert_at_col: str = "alert_at_ts") -> DataFrame:
    """received (JSON messages), alerts_triggered (instant alerts only) and the
    latency, publication text and alert time of the last alert in arrival order.

    ``max_by`` keeps one candidate per task, so the "last" lookup is a partial
    aggregate; non-alert rows carry a null order key and are skipped.
    """
    alert = F.coalesce(F.col(alert_col), F.lit(False))
    last = F.max_by(
        F.struct(F.col(latency_col).alias("lat"), F.col(published_col).alias("pa"), F.col(alert_at_col).alias("at")),
        F.when(alert, F.struct(*order_cols)))
    g = _grouped(view, group_cols).agg(
        F.count_if(F.col("is_json")).alias("received"),
        F.count_if(alert).alias("alerts_triggered"),
        last.alias("_last"))
    return g.select(*group_cols, "received", "alerts_triggered",
                    F.col("_last.lat").alias("last_e2e_latency_ms"),
                    F.col("_last.pa").alias("last_published_at"),
                    iso_format(F.col("_last.at")).alias("last_alert_at"))


def storage_counters(counts: DataFrame, batch_size: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """received, stored (flushed rows), errors, buffered, batches_flushed, from the
    counts that the storage consumer keeps of each micro-batch.

    Every message counts as received before parsing.  With batches (size > 1)
    rows are stored when a full batch is flushed; the rest stays buffered.
    A rejected message counts one error and does not take its batch along.
    """
    g = _grouped(counts, group_cols).agg(
        F.sum("received").alias("received"), F.sum("stored").alias("_ok"), F.sum("errors").alias("errors"))
    ok = F.col("_ok")
    if batch_size > 1:
        b = F.lit(int(batch_size))
        batches = F.floor(ok / b).cast("long")
        stored, buffered = batches * b, ok % b
    else:
        batches, stored, buffered = F.lit(0).cast("long"), ok, F.lit(0).cast("long")
    return g.select(*group_cols, "received", stored.alias("stored"), "errors",
                    buffered.alias("buffered"), batches.alias("batches_flushed"))


def stored_count(stored: DataFrame) -> DataFrame:
    """``SELECT COUNT(*)`` of the stored table."""
    return stored.agg(F.count(F.lit(1)).alias("stored_count"))


def progress_every_n(received: DataFrame, order_cols: Sequence[str], every: int = PROGRESS_EVERY) -> DataFrame:
    """One progress row per ``every`` received messages (running count, message id)."""
    o = with_global_ordinal(received, order_cols, name="received_so_far")
    return o.where(F.col("received_so_far") % F.lit(int(every)) == 0)


def progress_of_files(received: DataFrame, every: int = PROGRESS_EVERY) -> DataFrame:
    """:func:`progress_every_n` in the order of the files that ``received`` was read from; no row is moved."""
    o = with_file_position(received, "received_so_far")
    return o.where(F.col("received_so_far") % F.lit(int(every)) == 0)
