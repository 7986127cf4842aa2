"""Tumbling-window temperature statistics (global, per device, nested, latest).

Windows are epoch-aligned tumbling windows over the arrival time.  Each
aggregate is a hash aggregate with map-side partials, so the state per
window is O(devices), never O(messages), and a hot device cannot pile raw
values into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.numeric import mean_of, mean_parts, merged_parts, round2, safe_gt
from fieldpulse.schema import WINDOW_ALERT_THRESHOLD


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _window(time_col: str, size: str, start: str | None) -> Column:
    return F.window(time_col, size, size, start) if start else F.window(time_col, size)


def usable(readings: DataFrame, temp_col: str = "temperature") -> DataFrame:
    """Readings that enter a window: a finite temperature."""
    return readings.where(_finite(F.col(temp_col)))


def window_partials(readings: DataFrame, size: str = "10 seconds", time_col: str = "arrival_ts",
                    temp_col: str = "temperature", start: str | None = None) -> DataFrame:
    """Per window the mergeable aggregates: count, sums, min, max."""
    t = F.col(temp_col)
    return (usable(readings, temp_col)
            .groupBy(_window(time_col, size, start).alias("window"))
            .agg(F.count(F.lit(1)).alias("count"), *mean_parts(t),
                 F.min(t).alias("min_temperature"), F.max(t).alias("max_temperature")))


def window_partials_and_clock(readings: DataFrame, size: str = "10 seconds", time_col: str = "arrival_ts",
                              temp_col: str = "temperature", start: str | None = None) -> DataFrame:
    """:func:`window_partials` with the newest time of each window, also of rows without a usable
    temperature: one pass gives the aggregates and the clock.  Windows of such rows alone have count 0."""
    t = F.when(_finite(F.col(temp_col)), F.col(temp_col))
    return (readings.groupBy(_window(time_col, size, start).alias("window"))
            .agg(F.count(t).alias("count"), *mean_parts(t), F.min(t).alias("min_temperature"),
                 F.max(t).alias("max_temperature"), F.max(time_col).alias("newest")))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of the same windows (micro-batches, late rows) as one row per window."""
    return partials.groupBy("window").agg(
        F.sum("count").alias("count"), *merged_parts(),
        F.min("min_temperature").alias("min_temperature"), F.max("max_temperature").alias("max_temperature"))


def stats_of(partials: DataFrame, threshold: float = WINDOW_ALERT_THRESHOLD) -> DataFrame:
    """Window statistics from one row of aggregates per window."""
    avg = mean_of("count")
    return partials.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "count", avg.alias("avg_temperature"), "min_temperature", "max_temperature",
        safe_gt(avg, threshold).alias("alert_triggered"),
        F.lit(float(threshold)).alias("threshold"))


def window_global_stats(readings: DataFrame, size: str = "10 seconds",
                        threshold: float = WINDOW_ALERT_THRESHOLD, time_col: str = "arrival_ts",
                        temp_col: str = "temperature", start: str | None = None) -> DataFrame:
    """Per window: count, mean, min, max; alert when the unrounded mean > threshold."""
    return stats_of(window_partials(readings, size, time_col, temp_col, start), threshold)


def window_device_stats(readings: DataFrame, size: str = "10 seconds", time_col: str = "arrival_ts",
                        temp_col: str = "temperature", device_col: str = "device_id",
                        start: str | None = None) -> DataFrame:
    """Per window and device: count, mean rounded to 2 decimals, min, max."""
    d = device_partials(readings, size, time_col, temp_col, device_col, start)
    return d.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "device_id", F.col("d_count").alias("count"), round2(mean_of("d_count", "d")).alias("avg"),
                    F.col("d_min").alias("min"), F.col("d_max").alias("max"))


def device_partials(readings: DataFrame, size: str, time_col: str = "arrival_ts",
                    temp_col: str = "temperature", device_col: str = "device_id",
                    start: str | None = None) -> DataFrame:
    """First level of the nested statistics: (window, device) partial sums."""
    t = F.col(temp_col)
    return (usable(readings, temp_col)
            .groupBy(_window(time_col, size, start).alias("window"), F.col(device_col).alias("device_id"))
            .agg(F.count(F.lit(1)).alias("d_count"), *mean_parts(t, "d"),
                 F.min(t).alias("d_min"), F.max(t).alias("d_max")))


def _window_totals(d: DataFrame, *more: Column) -> DataFrame:
    """Second level: window totals from the device partials."""
    return d.groupBy("window").agg(
        F.sum("d_count").alias("count"), *merged_parts("d"),
        F.min("d_min").alias("min_temperature"), F.max("d_max").alias("max_temperature"), *more)


def window_stats_nested(readings: DataFrame, size: str = "10 seconds",
                        threshold: float = WINDOW_ALERT_THRESHOLD, **kw) -> DataFrame:
    """Window statistics with the per-device breakdown nested as a map.

    Two chained aggregations (device partials, then windows); in streaming
    this runs in ``append`` mode.  The map holds one entry per device seen in
    the window, which is the shape of the original output; with very many
    devices in a window use :func:`window_stats_nested_parts` or :func:`window_stats_flat`.
    """
    d = device_partials(readings, size, **kw)
    dev = F.struct(F.col("d_count").alias("count"), round2(mean_of("d_count", "d")).alias("avg"),
                   F.col("d_min").alias("min"), F.col("d_max").alias("max"))
    g = _window_totals(d, F.map_from_entries(F.collect_list(F.struct(F.col("device_id"), dev))).alias("per_device"))
    avg = mean_of("count", "d")
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "count", avg.alias("avg_temperature"), "min_temperature", "max_temperature", "per_device",
                    safe_gt(avg, threshold).alias("alert_triggered"), F.lit(float(threshold)).alias("threshold"))


PART_DEVICES = 1_000         # devices of one map of the nested statistics, about


def window_stats_nested_parts(readings: DataFrame, size: str = "10 seconds", threshold: float = WINDOW_ALERT_THRESHOLD,
                              part_devices: int = PART_DEVICES, **kw) -> DataFrame:
    """:func:`window_stats_nested` with each window's map split into ``parts`` by a hash of the device.

    A window has one row for each ``part``, about ``part_devices`` devices in
    its map, and the window's totals on it; no row holds all devices.  The
    number of parts follows from the window's devices, which are counted first.
    """
    d = device_partials(readings, size, **kw)
    avg = mean_of("count", "d")
    w = _window_totals(d, F.ceil(F.count(F.lit(1)) / F.lit(int(part_devices))).cast("int").alias("parts"))
    w = w.select("window", "count", avg.alias("avg_temperature"), "min_temperature", "max_temperature", "parts")
    totals = ["count", "avg_temperature", "min_temperature", "max_temperature"]
    dev = F.struct(F.col("d_count").alias("count"), round2(mean_of("d_count", "d")).alias("avg"),
                   F.col("d_min").alias("min"), F.col("d_max").alias("max"))
    each = d.select("window", "device_id", dev.alias("_s")).join(w, "window")
    part = F.pmod(F.xxhash64("device_id"), F.col("parts")).cast("int")
    g = each.groupBy("window", part.alias("part"), "parts", *totals).agg(
        F.map_from_entries(F.collect_list(F.struct("device_id", "_s"))).alias("per_device"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *totals,
                    "part", "parts", "per_device", safe_gt(F.col("avg_temperature"), threshold).alias("alert_triggered"),
                    F.lit(float(threshold)).alias("threshold"))


def exploded(nested: DataFrame) -> DataFrame:
    """:func:`window_stats_nested` (or its parts) with its map as rows, one per (window, device)."""
    rest = [c for c in nested.columns if c not in ("per_device", "part", "parts")]
    return nested.select(*rest, F.explode("per_device").alias("device_id", "_d")).select(
        *rest, "device_id", F.col("_d.count").alias("device_count"), F.col("_d.avg").alias("device_avg"),
        F.col("_d.min").alias("device_min"), F.col("_d.max").alias("device_max"))


def window_stats_flat(readings: DataFrame, size: str = "10 seconds",
                      threshold: float = WINDOW_ALERT_THRESHOLD, **kw) -> DataFrame:
    """The rows of :func:`exploded` without building the maps.

    Window totals come from the device partials (a second partial/final
    aggregate) and are joined back on the window; AQE splits a window that
    holds a very large number of devices.
    """
    d = device_partials(readings, size, **kw)
    avg = mean_of("count", "d")
    w = _window_totals(d).select("window", "count", avg.alias("avg_temperature"), "min_temperature", "max_temperature")
    return d.join(w, "window").select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "count", "avg_temperature", "min_temperature", "max_temperature",
        safe_gt(F.col("avg_temperature"), threshold).alias("alert_triggered"), F.lit(float(threshold)).alias("threshold"),
        "device_id", F.col("d_count").alias("device_count"), round2(mean_of("d_count", "d")).alias("device_avg"),
        F.col("d_min").alias("device_min"), F.col("d_max").alias("device_max"))


def latest_window(stats: DataFrame) -> DataFrame:
    """Newest non-empty window, with mean/min/max rounded to 2 decimals; none if empty.

    ``max_by`` is a partial aggregate: each task keeps its newest window.
    """
    cols = ["window_start", "window_end", "count", "avg_temperature", "min_temperature",
            "max_temperature", "alert_triggered", "threshold"]
    top = stats.agg(F.max_by(F.struct(*cols), F.col("window_end")).alias("w"))
    return top.where(F.col("w").isNotNull()).select(
        "w.window_start", "w.window_end", "w.count",
        round2(F.col("w.avg_temperature")).alias("avg_temperature"),
        round2(F.col("w.min_temperature")).alias("min_temperature"),
        round2(F.col("w.max_temperature")).alias("max_temperature"),
        "w.alert_triggered", "w.threshold")


def window_alerts(stats: DataFrame) -> DataFrame:
    """Closed windows whose mean exceeded the threshold."""
    return stats.where(F.col("alert_triggered"))


def latest_stats_document(nested: DataFrame) -> DataFrame:
    """The newest window of :func:`window_stats_nested` as one JSON document
    (mean/min/max rounded to 2 decimals, per-device breakdown included), the
    shape a stats endpoint serves.  One row, or none when there is no window.
    """
    doc = F.struct(
        F.col("window_start"), F.col("window_end"), F.col("count"),
        round2(F.col("avg_temperature")).alias("avg_temperature"),
        round2(F.col("min_temperature")).alias("min_temperature"),
        round2(F.col("max_temperature")).alias("max_temperature"),
        F.col("per_device"), F.col("alert_triggered"), F.col("threshold"))
    top = nested.agg(F.max_by(doc, F.col("window_end")).alias("d"))
    return top.where(F.col("d").isNotNull()).select(F.to_json("d").alias("stats"))
