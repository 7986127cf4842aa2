"""Harness analytics over sampled series: lag, backlog, drain and recovery.

Samples are pre-aggregated series (one row per run and sampling instant).
The ordered rules (drain, recovery streak) count the samples since the last
break of each run's sequence; they are evaluated with distributed positions
over blocks, so no task has to hold a whole run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.numeric import clamped_backlog, loss_pct, loss_pct_text
from fieldpulse.operators.ordinal import with_global_ordinal


def group_lag(offsets: DataFrame) -> DataFrame:
    """Sum of current, log-end and lag over a group's partitions.

    ``-`` (null) entries are skipped; the offset falls back to the log end
    when no partition has a committed offset; no rows gives zeros.
    """
    g = offsets.agg(F.sum("current_offset").alias("_cur"), F.sum("log_end_offset").alias("_end"),
                    F.sum("lag").alias("_lag"))
    return g.select(F.coalesce("_cur", "_end", F.lit(0)).cast("long").alias("offset"),
                    F.coalesce("_end", F.lit(0)).cast("long").alias("log_end_offset"),
                    F.coalesce("_lag", F.lit(0)).cast("long").alias("lag"))


BLOCK_ROWS = 10_000         # samples of a run that one task looks at together


def _since_break(samples: DataFrame, group_cols: list[str], ts_col: str, value_col: str, breaks) -> DataFrame:
    """Each sample with its 0-based position ``idx`` in its run and ``held``: how many
    samples up to it, itself included, have passed since the last break.

    ``breaks(value, previous)`` tells whether a sample breaks the sequence
    (``previous`` is null at a run's first one).  Positions come from the
    distributed ordinal; a run is cut into blocks of ``BLOCK_ROWS`` positions,
    and a block gets the previous value and the last break from the blocks
    before it.  Rows are never copied, and no task holds a whole run.
    """
    o = with_global_ordinal(samples, [ts_col], group_cols, name="_seq")
    o = o.withColumn("_block", F.floor((F.col("_seq") - 1) / F.lit(BLOCK_ROWS)))
    keys = [*group_cols, "_block"]
    inside, over = Window.partitionBy(*keys).orderBy("_seq"), Window.partitionBy(*group_cols).orderBy("_block")
    ends = (o.groupBy(*keys).agg(F.max_by(value_col, "_seq").alias("_end"))
            .withColumn("_carried", F.lag("_end").over(over)).drop("_end"))
    o = o.join(ends, keys)
    first = F.col("_seq") == F.col("_block") * BLOCK_ROWS + 1
    previous = F.when(first, F.col("_carried")).otherwise(F.lag(value_col).over(inside))
    o = o.withColumn("_previous", previous)
    o = o.withColumn("_break", F.when(F.coalesce(breaks(F.col(value_col), F.col("_previous")), F.lit(True)), F.col("_seq")))
    lasts = (o.groupBy(*keys).agg(F.max("_break").alias("_last"))
             .withColumn("_before", F.max("_last").over(over.rowsBetween(Window.unboundedPreceding, -1))).drop("_last"))
    here = F.max("_break").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (o.withColumn("_here", here).join(lasts, keys)
            .select(*group_cols, (F.col("_seq") - 1).alias("idx"), F.col(value_col).alias("value"),
                    (F.col("_seq") - F.coalesce("_here", "_before", F.lit(0))).alias("held")))


def drain_stable(samples: DataFrame, group_cols: Sequence[str] = ("run",), ts_col: str = "sample_ts",
                 value_col: str = "value", stable_needed: int = 3, timeout: int | None = None) -> DataFrame:
    """First sample equal to its predecessor ``stable_needed`` times in a row.

    A change of the value is the break; ``drained_index`` is null when the
    value never holds that long.  ``timed_out`` is true when there is no such
    sample within the first ``timeout`` samples (anywhere, without a timeout).
    """
    group_cols = list(group_cols)
    f = _since_break(samples.select(*group_cols, ts_col, value_col), group_cols, ts_col, value_col,
                     lambda value, previous: value != previous)
    first = F.min_by(F.struct("idx", F.col("value").alias("v")), F.when(F.col("held") >= int(stable_needed), F.col("idx")))
    g = f.groupBy(*group_cols).agg(first.alias("_d"))
    idx = F.col("_d.idx").cast("long")
    timed_out = idx.isNull() if timeout is None else (idx.isNull() | (idx >= F.lit(int(timeout))))
    return g.select(*group_cols, idx.alias("drained_index"), F.col("_d.v").alias("drained_value"),
                    timed_out.alias("timed_out"))


def recovery_streak(samples: DataFrame, group_cols: Sequence[str] = ("run",), ts_col: str = "sample_ts",
                    value_col: str = "value", limit: int = 5, needed: int = 10, horizon: int = 180) -> DataFrame:
    """First sample at which ``value <= limit`` has held ``needed`` samples in a row.

    A value above the limit is the break.  ``recovery_s`` is index + 1 when
    reached within ``horizon`` samples, otherwise ``"<horizon>+"``;
    ``recovery_index`` is the raw index.
    """
    group_cols = list(group_cols)
    f = _since_break(samples.select(*group_cols, ts_col, value_col), group_cols, ts_col, value_col,
                     lambda value, previous: value > F.lit(limit))
    reached = F.when(F.col("held") >= int(needed), F.col("idx"))
    g = f.groupBy(*group_cols).agg(F.min(reached).cast("long").alias("recovery_index"))
    text = F.when(F.col("recovery_index") < F.lit(horizon), (F.col("recovery_index") + 1).cast("string")) \
        .otherwise(F.lit(f"{horizon}+"))
    return g.select(*group_cols, "recovery_index", text.alias("recovery_s"))


def first_recovery(samples: DataFrame, clock_start: Column, predicate: Column,
                   group_cols: Sequence[str] = ("run",), ts_col: str = "sample_ts",
                   horizon_s: int | None = None, label: str = "120+") -> DataFrame:
    """Seconds from ``clock_start`` to the first sample at or after it where
    ``predicate`` holds; ``label`` when none (or beyond ``horizon_s``)."""
    group_cols = list(group_cols)
    t = F.col(ts_col)
    first = F.min(F.when((t >= clock_start) & predicate, t))
    g = samples.groupBy(*group_cols).agg(first.alias("_first"))
    secs = (F.unix_seconds(F.col("_first").cast("timestamp")) - F.unix_seconds(clock_start.cast("timestamp")))
    within = secs.isNotNull() if horizon_s is None else secs <= F.lit(horizon_s)
    return g.select(*group_cols, F.when(within, secs).alias("recovery_seconds"),
                    F.when(within, secs.cast("string")).otherwise(F.lit(label)).alias("recovery_s"))


def peak_backlog(samples: DataFrame, group_cols: Sequence[str] = ("run",), ts_col: str = "sample_ts",
                 value_col: str = "value", phase_start: Column | None = None) -> DataFrame:
    """Running maximum of the sampled backlog at the end of the phase (0 if none)."""
    v = F.col(value_col)
    if phase_start is not None:
        v = F.when(F.col(ts_col) >= phase_start, v)
    return samples.groupBy(*group_cols).agg(F.coalesce(F.max(v), F.lit(0)).cast("long").alias("peak_backlog"))


def backlog_series(samples: DataFrame, received_col: str = "value", stored_col: str = "stored",
                   baseline: int = 0) -> DataFrame:
    """Per sample ``max(received - stored - baseline, 0)``."""
    return samples.withColumn("backlog", clamped_backlog(F.col(received_col), F.col(stored_col), baseline))


def snapshot_counts(view: DataFrame, ts_col: str, before: Column, after: Column,
                    group_cols: Sequence[str], batch_size: int) -> DataFrame:
    """Counters at two instants: table rows, received messages, stored-counter value."""
    t = F.col(ts_col)
    ok = F.col("is_valid")
    g = view.groupBy(*group_cols).agg(
        F.count_if(ok & (t < before)).alias("db_before"), F.count_if(ok & (t < after)).alias("db_after"),
        F.count_if(t < before).alias("received_before"), F.count_if(t < after).alias("received_after"))
    b = F.lit(int(max(batch_size, 1)))
    return g.select("*", (F.floor(F.col("db_before") / b) * b).cast("long").alias("stored_before"),
                    (F.floor(F.col("db_after") / b) * b).cast("long").alias("stored_after"))


def received_max(snap: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """received = the larger of the table count and the stored counter."""
    return snap.select(*group_cols, "db_after", "stored_after",
                       F.greatest("db_after", "stored_after").alias("received"))


def outage_messages(snap: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Largest of the table, received and stored deltas across the outage, floor 0."""
    d1 = F.col("db_after") - F.col("db_before")
    d2 = F.col("received_after") - F.col("received_before")
    d3 = F.col("stored_after") - F.col("stored_before")
    return snap.select(*group_cols, d1.alias("db_delta"), d2.alias("metrics_delta"), d3.alias("stored_delta"),
                       F.greatest(d2, d3, d1, F.lit(0)).cast("long").alias("messages_during"))


def loss(view: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """sent, stored and the loss percentage (raw and two-decimal text) per group."""
    g = view.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("is_valid")).alias("stored"))
    return g.select(*group_cols, "sent", "stored", loss_pct(F.col("sent"), F.col("stored")).alias("loss_pct"),
                    loss_pct_text(F.col("sent"), F.col("stored")).alias("loss_text"))
