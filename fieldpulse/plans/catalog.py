"""Registered queries: one per operator of the sensor pipeline.

Each entry takes ``(spark, sf_dir)``, reads the generated tables (``events``
plays the sensor stream, see ``sources.adapters``) and returns a lazy
DataFrame over the whole table.  A few entries run a real write/read or a
Structured Streaming job into a scratch folder under the session's
checkpoint directory first, because the operator *is* that I/O.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.functions import numeric as N
from fieldpulse.functions import parsing as P
from fieldpulse.functions import timefmt as TF
from fieldpulse.operators import alerts as AL
from fieldpulse.operators import counters as C
from fieldpulse.operators import latency as L
from fieldpulse.operators import recovery as R
from fieldpulse.operators import replay as RP
from fieldpulse.operators import resources as RS
from fieldpulse.operators import windows as W
from fieldpulse.operators.ordinal import with_global_ordinal
from fieldpulse.operators.positions import file_slice
from fieldpulse.schema import READING_COLUMNS, STORAGE_BATCH_SIZE
from fieldpulse.session import prepare, scratch_path
from fieldpulse.sinks import writers as K
from fieldpulse.sources import adapters as A
from fieldpulse.sources import files as FS
from fieldpulse.sources import messages as M
from fieldpulse.streaming import jobs as S
from fieldpulse.streaming.buffer import BufferedTable
from fieldpulse.streaming.window_store import WindowStore

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries (window sizes follow FIXTURES.md:
# 10 s windows would hold about one row each on the generated stream).
DAY = "1 day"
HOUR = "1 hour"
WIN_THR = 50.0
INSTANT_THR = 40.0
ORDER = ["arrival_ts", "event_id"]
RECOVERY_CLOCK = "2024-01-10 00:00:00"
RECOVERY_BASELINE = 3
LAG_RECOVERY_LIMIT_S = 120 * 60      # the rule is 120 samples; here samples are hours apart
MICRO_BATCHES = 6
BURST_PHASE_START = "2024-01-15 00:00:00"
SLICE_SKIP, SLICE_TAKE = 100, 20


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return A.events(spark, sf)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---------------------------------------------------------------- windows
def q_window_global_stats(spark, sf):
    return W.window_global_stats(A.readings(_ev(spark, sf)), DAY, WIN_THR)


def q_window_device_stats(spark, sf):
    return W.window_device_stats(A.readings(_ev(spark, sf)), DAY)


def q_window_stats_nested(spark, sf):
    return W.exploded(W.window_stats_nested_parts(A.readings(_ev(spark, sf)), DAY, WIN_THR))


def q_window_stats_flat(spark, sf):
    return W.window_stats_flat(A.readings(_ev(spark, sf)), DAY, WIN_THR)


def q_latest_window(spark, sf):
    return W.latest_window(W.window_global_stats(A.readings(_ev(spark, sf)), HOUR, WIN_THR))


def q_window_alert_predicate(spark, sf):
    return W.window_alerts(W.window_global_stats(A.readings(_ev(spark, sf)), HOUR, WIN_THR))


# ---------------------------------------------------------------- messages
def _analytics(spark, sf) -> DataFrame:
    msgs = A.messages(_ev(spark, sf))
    return M.analytics_view(M.decode(msgs, fields=M.ANALYTICS_FIELDS))


def _storage(spark, sf) -> DataFrame:
    msgs = A.messages(_ev(spark, sf))
    return M.storage_view(M.decode(msgs))


def _alert_at():
    return TF.add_millis(F.col("arrival_ts"), F.col("event_id") % F.lit(A.ALERT_DELAY_MOD_MS))


def q_reading_projection(spark, sf):
    v = _storage(spark, sf)
    return v.where("is_valid").select("event_id", *READING_COLUMNS)


def q_analytics_projection(spark, sf):
    v = _analytics(spark, sf)
    return v.where("is_json").select("event_id", F.col("a_device_id").alias("device_id"),
                                     F.col("a_temperature").alias("temperature"),
                                     F.col("a_published_at").alias("published_at"))


def q_valid_reading_filter(spark, sf):
    return _storage(spark, sf).select("event_id", "is_valid", "reject_reason")


def q_not_null_and_length_check(spark, sf):
    v = M.not_null_and_length_flags(M.storage_view(M.decode(A.mixed_messages(_ev(spark, sf)))))
    return v.select("event_id", "timestamp_missing", "device_id_missing", "too_long")


def q_message_reject_reasons(spark, sf):
    """Every kind of accepted and rejected message, as both consumers see it."""
    d = M.analytics_view(M.decode(A.mixed_messages(_ev(spark, sf))))
    v = M.storage_view(d)
    return v.select("event_id", "is_json", "is_object", "temperature_ok", "is_valid", "reject_reason", "irrigation_needed")


def q_instant_alert_filter(spark, sf):
    v = _analytics(spark, sf).where("temperature_ok")
    return (v.where(AL.instant_alert_flag(F.col("a_temperature"), True, INSTANT_THR))
            .select("event_id", F.col("a_device_id").alias("device_id"),
                    F.col("a_temperature").alias("temperature"), F.lit(INSTANT_THR).alias("threshold")))


def q_threshold_choice(spark, sf):
    r = A.readings(_ev(spark, sf))
    flag = F.lit(True)
    thr = AL.threshold_choice_col(flag)
    return r.select("event_id", "temperature", thr.alias("threshold"),
                    N.safe_gt(F.col("temperature"), thr).alias("exceeds"))


def q_analytics_counters(spark, sf):
    v = _analytics(spark, sf)
    at = _alert_at()
    alert = F.col("temperature_ok") & AL.instant_alert_flag(F.col("a_temperature"), True, INSTANT_THR)
    lat = TF.latency_default(TF.e2e_latency_ms(P.parse_published_at(F.col("a_published_at")), at))
    v = v.select("*", alert.alias("is_alert"), at.alias("alert_at_ts"), lat.alias("e2e_latency_ms"))
    return C.analytics_counters(v, "is_alert", ORDER)


def q_storage_counters(spark, sf):
    return _buffered(spark, sf).counters()


def q_stored_count(spark, sf):
    return C.stored_count(S.stored_readings(spark, _stored(spark, sf)))


def q_received_vs_parsed(spark, sf):
    """Storage counts a message before parsing; analytics after the JSON parse."""
    v = _analytics(spark, sf)
    return v.agg(F.count(F.lit(1)).alias("storage_received"), F.count_if("is_json").alias("analytics_received"),
                 F.count_if("temperature_ok").alias("analytics_windowed"))


def q_progress_every_n(spark, sf):
    """Progress of a consumer that takes the table in file order."""
    return C.progress_of_files(_ev(spark, sf)).select("event_id", "received_so_far")


# ---------------------------------------------------------------- alerts / latency
def _timed(spark, sf) -> DataFrame:
    return A.timed_readings(_ev(spark, sf))


def _latencies(spark, sf) -> DataFrame:
    t = _timed(spark, sf)
    a = AL.instant_alerts(t, True, INSTANT_THR, alert_at=F.col("alert_at"))
    return a.select("event_id", F.col("crop_type").alias("run"), F.col("e2e_latency_ms").alias("latency_ms"))


def q_e2e_latency_ms(spark, sf):
    t = _timed(spark, sf)
    return t.select("event_id", TF.e2e_latency_ms(P.parse_published_at(F.col("published_at")),
                                                  F.col("alert_at")).alias("e2e_latency_ms"))


def q_latency_default(spark, sf):
    v = _analytics(spark, sf)
    lat = TF.e2e_latency_ms(P.parse_published_at(F.col("a_published_at")), _alert_at())
    return v.select("event_id", TF.latency_default(lat).alias("latency_ms"))


def q_parse_published_at(spark, sf):
    t = _timed(spark, sf)
    return t.select("event_id", "published_at", P.parse_published_at(F.col("published_at")).alias("published_ts"))


def q_p95_floor_rank(spark, sf):
    return L.p95_floor_rank(_latencies(spark, sf), "latency_ms", ["run"])


def q_sort_values(spark, sf):
    """Full ascending sort of the latency list: each value with its 1-based position."""
    values = _latencies(spark, sf).select("latency_ms", "event_id")
    return with_global_ordinal(values, ["latency_ms", "event_id"], name="position").drop("event_id")


def q_latency_summary(spark, sf):
    return L.latency_summary(_latencies(spark, sf), "latency_ms", ["run"])


def q_latency_match(spark, sf):
    t = _timed(spark, sf).withColumnRenamed("crop_type", "run")
    alert = AL.instant_alert_flag(F.col("temperature"), True, INSTANT_THR)
    lat = TF.latency_default(TF.e2e_latency_ms(P.parse_published_at(F.col("published_at")), F.col("alert_at")))
    view = t.select("run", "arrival_ts", "event_id", "published_at", alert.alias("is_alert"),
                    lat.alias("e2e_latency_ms"))
    return L.latency_match(view, "is_alert", ["run"], ORDER)


def _instant_records(t: DataFrame) -> DataFrame:
    a = AL.instant_alerts(t, True, INSTANT_THR, alert_at=F.col("alert_at"))
    return AL.alert_records_instant(a)


def q_alert_sink(spark, sf):
    ev = _ev(spark, sf)
    inst = _instant_records(A.timed_readings(ev))
    win = AL.alert_records_window(W.window_alerts(W.window_global_stats(A.readings(ev), HOUR, WIN_THR)), 3600)
    path = scratch_path(spark, "alerts")
    K.append_table(AL.alert_sink(inst, win), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- scalar functions
def _samples(spark, sf) -> DataFrame:
    return A.container_samples(_ev(spark, sf))


def q_parse_mem_mb(spark, sf):
    s = _samples(spark, sf)
    return s.select("event_id", "mem_used", P.parse_mem_mb(F.col("mem_used")).alias("mem_mb"))


def q_parse_net_mb(spark, sf):
    s = _samples(spark, sf)
    return s.select("event_id", "net_io", P.parse_net_mb(F.col("net_io")).alias("net_mb"))


def q_parse_cpu(spark, sf):
    s = _samples(spark, sf)
    return s.select("event_id", "cpu_percent", P.parse_cpu(F.col("cpu_percent")).alias("cpu"))


def q_round2(spark, sf):
    ev = _ev(spark, sf)
    return ev.select("event_id", N.round2(F.col("value") / F.lit(3.0)).alias("rounded"))


def q_iso_format(spark, sf):
    ev = _ev(spark, sf)
    return ev.select("event_id", TF.iso_format(F.col("ts")).alias("iso"), TF.batch_stamp(F.col("ts")).alias("stamp"))


def q_stamp_second(spark, sf):
    ev = _ev(spark, sf)
    return ev.select("event_id", TF.stamp_second(F.col("ts")).alias("published_at"))


def _loss(spark, sf) -> DataFrame:
    msgs = A.messages(_ev(spark, sf))
    v = M.storage_view(M.decode(msgs))
    return R.loss(v, ["run"])


def q_loss_pct(spark, sf):
    return _loss(spark, sf)


def _samples_hourly(spark, sf) -> DataFrame:
    return A.hourly_samples(_ev(spark, sf))


def q_clamped_backlog(spark, sf):
    return R.backlog_series(_samples_hourly(spark, sf)).select("run", "sample_ts", "value", "stored", "backlog")


# ---------------------------------------------------------------- resources
def _report(spark, sf) -> DataFrame:
    return RS.resource_by_container(_samples(spark, sf), A.SAMPLE_SERVICES)


def q_service_filter(spark, sf):
    return RS.service_filter(_samples(spark, sf), A.SAMPLE_SERVICES).select("event_id", "container")


def q_resource_by_container(spark, sf):
    return _report(spark, sf)


def q_pair_format(spark, sf):
    return RS.pair_format(_report(spark, sf), ["cpu", "ram_mb", "net_mb"])


def q_report_field_lookup(spark, sf):
    s = _samples(spark, sf)
    rep = RS.resource_by_container(s, A.SAMPLE_SERVICES)
    containers = s.select(RS.container_name(s).alias("container")).distinct()
    return RS.report_field_lookup(rep, containers, "peak_cpu")


# ---------------------------------------------------------------- harness series
def q_group_lag(spark, sf):
    return R.group_lag(A.partition_offsets(_ev(spark, sf)))


def q_drain_stable(spark, sf):
    return R.drain_stable(_samples_hourly(spark, sf))


def q_recovery_streak(spark, sf):
    return R.recovery_streak(_samples_hourly(spark, sf), limit=5, needed=10, horizon=180)


def q_recovery_streak_long(spark, sf):
    """The stricter rule of the log-based broker: 30 samples in a row."""
    return R.recovery_streak(_samples_hourly(spark, sf), limit=5, needed=30, horizon=180)


def q_lag_recovery(spark, sf):
    """First sample with a lag of at most 5 after the clock starts, within the time limit."""
    s = _samples_hourly(spark, sf)
    return R.first_recovery(s, _ts(RECOVERY_CLOCK), F.col("value") <= F.lit(5), horizon_s=LAG_RECOVERY_LIMIT_S)


def q_first_recovery(spark, sf):
    s = _samples_hourly(spark, sf)
    return R.first_recovery(s, _ts(RECOVERY_CLOCK), F.col("value") > F.lit(RECOVERY_BASELINE))


def q_peak_backlog(spark, sf):
    return R.peak_backlog(_samples_hourly(spark, sf), phase_start=_ts(BURST_PHASE_START))


def _snap(spark, sf) -> DataFrame:
    v = _storage(spark, sf)
    return R.snapshot_counts(v, "arrival_ts", _ts(A.SNAPSHOT_BEFORE), _ts(A.SNAPSHOT_AFTER), ["run"],
                             STORAGE_BATCH_SIZE)


def q_received_max(spark, sf):
    return R.received_max(_snap(spark, sf), ["run"])


def q_outage_messages(spark, sf):
    return R.outage_messages(_snap(spark, sf), ["run"])


# ---------------------------------------------------------------- sources
def q_topic_scan_analytics(spark, sf):
    d = M.decode(A.counter_documents(_ev(spark, sf)), fields=("k",))
    k = F.from_json(F.col("value"), "k int").getField("k")
    return d.where("is_json").select(F.col("event_id").alias("offset"), "value", k.alias("k"))


def q_topic_scan_storage(spark, sf):
    d = M.decode(A.mixed_messages(_ev(spark, sf)))
    return d.select(F.col("event_id").alias("offset"), (~F.col("is_object")).alias("is_error"))


def q_counter_snapshot_read(spark, sf):
    docs = A.counter_documents(_ev(spark, sf))
    return docs.select("event_id", M.counter_field(F.col("value"), "k").alias("k"),
                       M.counter_field(F.col("value"), "missing", missing_as_empty=True).alias("missing"))


def q_replay_batches(spark, sf):
    return RP.replay_files(_ev(spark, sf)).select("event_id", "row_no", "batch_no", "release_offset_s")


def q_batch_slice(spark, sf):
    return file_slice(_ev(spark, sf), SLICE_SKIP, SLICE_TAKE, name="row_no").select("event_id", "row_no")


def q_offset_table_scan(spark, sf):
    offs = A.partition_offsets(_ev(spark, sf))
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = offs.select(F.concat_ws("   ", "group", "topic", F.col("partition").cast("string"), dash("current_offset"),
                                   dash("log_end_offset"), dash("lag"), F.lit("-"), F.lit("-"), F.lit("-")).alias("value"))
    # the listing's banner and header lines, emitted once per listing (group)
    head = offs.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(
        F.concat(F.lit("Consumer group '"), F.col("group"), F.lit("' has no active members.")),
        F.lit("GROUP   TOPIC   PARTITION  CURRENT-OFFSET  LOG-END-OFFSET  LAG   CONSUMER-ID  HOST  CLIENT-ID"),
    )).alias("value"))
    lines = head.unionByName(rows).withColumn("source", F.lit("listing"))
    return FS.parse_offset_listing(lines).drop("source")


def q_csv_reading_scan(spark, sf):
    ev = _ev(spark, sf)
    r = A.readings(ev)
    path = scratch_path(spark, "readings-csv")
    # header order differs from the table and carries an extra column
    (r.select("temperature", "crop_type", "device_id", F.col("event_id").alias("extra_id"),
              F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))
     .write.option("header", True).csv(path))
    return FS.read_readings_csv(spark, path)


def q_stats_sample_scan(spark, sf):
    path = scratch_path(spark, "stats-csv")
    absent = F.col("event_id") % 11 == 0                  # such samples lack their measurements
    s = _samples(spark, sf)
    cols = [F.when(~absent, F.col(c)).alias(c) for c in ("cpu_percent", "mem_used", "net_io")]
    s.select("timestamp", F.col("container").alias("name"), *cols).write.option("header", True).csv(path)
    return FS.read_stats_samples(spark, path)


def q_latency_scan(spark, sf):
    path = scratch_path(spark, "latencies")
    _latencies(spark, sf).select(F.col("latency_ms").cast("string").alias("value")).write.text(path)
    return FS.read_latencies(spark, path)


# ---------------------------------------------------------------- sinks
def q_publish_json(spark, sf):
    r = A.readings(_ev(spark, sf)).select(
        "event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "device_id", "crop_type", "temperature")
    path = scratch_path(spark, "published")
    K.append_table(K.publish_json(r, ["timestamp", "device_id", "crop_type", "temperature"], key="event_id"), path)
    return spark.read.parquet(path)


def dealt_stream(table: DataFrame, key: str, batches: int) -> DataFrame:
    """A table as a stream of ``batches`` micro-batches, its rows dealt by a hash of ``key``.

    The table is written once into the scratch folder.  Every micro-batch holds
    rows of all times, so nothing arrives in order.
    """
    spark = table.sparkSession
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "stream-source")
    table.repartition(files, key).write.parquet(path)
    return (spark.readStream.schema(table.schema).format("parquet")
            .option("maxFilesPerTrigger", str(-(-files // batches))).load(path))


def _stored(spark, sf) -> str:
    """Run the storage consumer over the table's messages; where it has put them."""
    path = scratch_path(prepare(spark), "storage")
    S.run_storage(A.messages(_events_stream(spark, sf)), path, scratch_path(spark, "storage-ckpt"))
    return path


def _buffered(spark, sf) -> BufferedTable:
    """Run the storage consumer with a buffer between its micro-batches."""
    path = scratch_path(prepare(spark), "buffered")
    buffer = BufferedTable(spark, f"{path}/table", STORAGE_BATCH_SIZE)
    S.run_storage(A.messages(_events_stream(spark, sf)), path, scratch_path(spark, "buffered-ckpt"), buffer=buffer)
    return buffer


def q_append_reading(spark, sf):
    return S.stored_readings(spark, _stored(spark, sf)).select(*READING_COLUMNS)


def q_drain(spark, sf):
    """The number of rows that a drain inserts after the whole table has been consumed."""
    flushed = _buffered(spark, sf).drain()
    return spark.createDataFrame([(flushed,)], "flushed long")


def q_append_batch(spark, sf):
    """Inserts of the buffered consumer with their rows; the rows that still wait come as one that is not flushed."""
    buffer = _buffered(spark, sf)

    def inserts(rows, flushed):
        return rows.groupBy(F.col("insert_no").alias("batch_id")).agg(
            F.count(F.lit(1)).alias("rows"), F.lit(flushed).alias("flushed"))

    parts = [inserts(rows, flushed) for rows, flushed in ((buffer.table(), True), (buffer.waiting(), False)) if rows is not None]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def q_write_resource_report(spark, sf):
    path = scratch_path(spark, "resources-json")
    K.write_report(_report(spark, sf), path)
    return spark.read.schema(_report(spark, sf).schema).json(path)


def q_append_summary(spark, sf):
    path = scratch_path(spark, "summary-csv")
    rows = _loss(spark, sf).select(F.lit("A").alias("scenario"), F.lit("spark").alias("broker"), "run",
                                   "sent", "stored", F.col("loss_text").alias("lost_pct"))
    K.append_summary(rows.where(F.col("run") < "p"), path)
    K.append_summary(rows.where(~(F.col("run") < "p")), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("scenario", "broker", "run", F.col("sent").cast("long"), F.col("stored").cast("long"), "lost_pct")


def q_result_pairs(spark, sf):
    return K.result_pairs(_loss(spark, sf), ["run"], ["sent", "stored", "loss_text"])


# ---------------------------------------------------------------- streaming
def _events_stream(spark, sf) -> DataFrame:
    """The events table in micro-batches that each hold rows of all times."""
    prepare(spark)
    return dealt_stream(A.events(spark, sf), "event_id", MICRO_BATCHES)


def _streamed_windows(spark, sf) -> WindowStore:
    """Windows of the table's readings, which come in no order, after the stream has ended."""
    store = WindowStore(spark, scratch_path(prepare(spark), "windows"), HOUR, WIN_THR, in_order=False)
    S.run_windows(A.readings(_events_stream(spark, sf)), store, scratch_path(spark, "window-ckpt"))
    store.finish()
    return store


def q_tumbling_arrival_window(spark, sf):
    return _streamed_windows(spark, sf).stats()


def q_window_alert_stream(spark, sf):
    return _streamed_windows(spark, sf).alerts()


def q_instant_alert_stream(spark, sf):
    rec = _instant_records(A.timed_readings(_events_stream(spark, sf)))
    out, ck = scratch_path(spark, "instant-alerts"), scratch_path(spark, "instant-alerts-ckpt")
    S.run_to_parquet(rec, out, ck, mode="append")
    return spark.read.parquet(out)


QUERIES: dict[str, Query] = {
    # sources
    "csv_reading_scan": q_csv_reading_scan,
    "topic_scan_analytics": q_topic_scan_analytics,
    "topic_scan_storage": q_topic_scan_storage,
    "replay_batches": q_replay_batches,
    "stats_sample_scan": q_stats_sample_scan,
    "latency_scan": q_latency_scan,
    "offset_table_scan": q_offset_table_scan,
    "stored_count": q_stored_count,
    "counter_snapshot_read": q_counter_snapshot_read,
    # sinks
    "publish_json": q_publish_json,
    "append_reading": q_append_reading,
    "append_batch": q_append_batch,
    "drain": q_drain,
    "write_resource_report": q_write_resource_report,
    "append_summary": q_append_summary,
    "result_pairs": q_result_pairs,
    "alert_sink": q_alert_sink,
    # projections / filters
    "reading_projection": q_reading_projection,
    "analytics_projection": q_analytics_projection,
    "instant_alert_filter": q_instant_alert_filter,
    "threshold_choice": q_threshold_choice,
    "window_alert_predicate": q_window_alert_predicate,
    "service_filter": q_service_filter,
    "valid_reading_filter": q_valid_reading_filter,
    "message_reject_reasons": q_message_reject_reasons,
    "not_null_and_length_check": q_not_null_and_length_check,
    "latency_match": q_latency_match,
    "report_field_lookup": q_report_field_lookup,
    # scalar functions
    "parse_mem_mb": q_parse_mem_mb,
    "parse_net_mb": q_parse_net_mb,
    "parse_cpu": q_parse_cpu,
    "parse_published_at": q_parse_published_at,
    "e2e_latency_ms": q_e2e_latency_ms,
    "latency_default": q_latency_default,
    "loss_pct": q_loss_pct,
    "round2": q_round2,
    "pair_format": q_pair_format,
    "clamped_backlog": q_clamped_backlog,
    "iso_format": q_iso_format,
    "stamp_second": q_stamp_second,
    # aggregations
    "window_global_stats": q_window_global_stats,
    "window_device_stats": q_window_device_stats,
    "window_stats_nested": q_window_stats_nested,
    "window_stats_flat": q_window_stats_flat,
    "latest_window": q_latest_window,
    "analytics_counters": q_analytics_counters,
    "storage_counters": q_storage_counters,
    "resource_by_container": q_resource_by_container,
    "latency_summary": q_latency_summary,
    "group_lag": q_group_lag,
    "received_max": q_received_max,
    "outage_messages": q_outage_messages,
    "peak_backlog": q_peak_backlog,
    # ordered computations
    "p95_floor_rank": q_p95_floor_rank,
    "sort_values": q_sort_values,
    "drain_stable": q_drain_stable,
    "recovery_streak": q_recovery_streak,
    "recovery_streak_long": q_recovery_streak_long,
    "lag_recovery": q_lag_recovery,
    "first_recovery": q_first_recovery,
    "progress_every_n": q_progress_every_n,
    "batch_slice": q_batch_slice,
    # streaming
    "tumbling_arrival_window": q_tumbling_arrival_window,
    "instant_alert_stream": q_instant_alert_stream,
    "window_alert_stream": q_window_alert_stream,
    "received_vs_parsed": q_received_vs_parsed,
}
