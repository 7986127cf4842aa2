"""Per-message threshold alerts, window alerts and the alert record stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.numeric import safe_gt
from fieldpulse.functions.parsing import parse_published_at
from fieldpulse.functions.timefmt import e2e_latency_ms, latency_default
from fieldpulse.schema import INSTANT_ALERT_THRESHOLD, WINDOW_ALERT_THRESHOLD

ALERT_COLUMNS = ["kind", "device_id", "temperature", "threshold", "window_size_s", "count",
                 "published_at", "alert_at", "e2e_latency_ms"]


def threshold_choice(instant: bool, instant_threshold: float = INSTANT_ALERT_THRESHOLD,
                     window_threshold: float = WINDOW_ALERT_THRESHOLD) -> float:
    """The benchmark (instant) threshold when instant alerts are on, else the normal one."""
    return float(instant_threshold if instant else window_threshold)


def threshold_choice_col(flag: Column, instant_threshold: float = INSTANT_ALERT_THRESHOLD,
                         window_threshold: float = WINDOW_ALERT_THRESHOLD) -> Column:
    return F.when(flag, F.lit(float(instant_threshold))).otherwise(F.lit(float(window_threshold)))


def instant_alert_flag(temp: Column, instant: bool = True, threshold: float | None = None) -> Column:
    thr = threshold_choice(instant) if threshold is None else float(threshold)
    return F.lit(bool(instant)) & safe_gt(temp, thr)


def instant_alerts(view: DataFrame, instant: bool = True, threshold: float | None = None,
                   alert_at: Column | None = None, temp_col: str = "temperature",
                   published_col: str = "published_at") -> DataFrame:
    """Stateless per-message alerts: ``temperature > threshold`` while the flag is on.

    ``alert_at`` is the processing instant (``current_timestamp()`` in a live
    stream; a column in tests and replays).  An unknown publication time gives
    latency 0.0.
    """
    thr = threshold_choice(instant) if threshold is None else float(threshold)
    at = F.current_timestamp().cast("timestamp_ntz") if alert_at is None else alert_at
    t = F.col(temp_col)
    lat = latency_default(e2e_latency_ms(parse_published_at(F.col(published_col)), at))
    return (view.where(instant_alert_flag(t, instant, thr))
            .select("*", F.lit("instant").alias("kind"), F.lit(thr).alias("threshold"),
                    at.alias("alert_at_ts"), lat.alias("e2e_latency_ms")))


def alert_records_instant(alerts: DataFrame, device_col: str = "device_id", temp_col: str = "temperature",
                          published_col: str = "published_at") -> DataFrame:
    return alerts.select(
        F.lit("instant").alias("kind"), F.col(device_col).alias("device_id"),
        F.col(temp_col).alias("temperature"), F.col("threshold"),
        F.lit(None).cast("long").alias("window_size_s"), F.lit(None).cast("long").alias("count"),
        F.col(published_col).alias("published_at"), F.col("alert_at_ts").alias("alert_at"),
        F.col("e2e_latency_ms"))


def alert_records_window(window_alerts_df: DataFrame, window_size_s: int) -> DataFrame:
    return window_alerts_df.select(
        F.lit("window").alias("kind"), F.lit(None).cast("string").alias("device_id"),
        F.col("avg_temperature").alias("temperature"), F.col("threshold"),
        F.lit(int(window_size_s)).cast("long").alias("window_size_s"), F.col("count"),
        F.lit(None).cast("string").alias("published_at"), F.col("window_end").alias("alert_at"),
        F.lit(None).cast("double").alias("e2e_latency_ms"))


def alert_sink(instant_records: DataFrame, window_records: DataFrame) -> DataFrame:
    """One stream of alert records (instant and window) with a common schema."""
    return instant_records.select(*ALERT_COLUMNS).unionByName(window_records.select(*ALERT_COLUMNS))
