"""Command line entry points (``python -m fieldpulse <command> ...``).

Each command is a Spark job over files (or a topic) built from the library
operators; only one-line summaries are printed on the driver.

  resources  STATS_CSV OUT_DIR        per-container avg/peak report (JSON lines, or one object)
  latency    LATENCY_FILE             "avg,min,max,p95" of a latency list
  group-lag  LISTING_FILE             "offset<TAB>log_end<TAB>lag" of a consumer-group listing
  storage    SOURCE_DIR TABLE_DIR     storage consumer: TABLE_DIR/rows (accepted and rejected) and TABLE_DIR/counts,
                                      with --batch-size above 1 TABLE_DIR/table in full batches
  drain      TABLE_DIR                insert what waits in the buffer of a stopped consumer; prints how many rows
  counters   TABLE_DIR                counters of a storage consumer, running or stopped
  fold       TABLE_DIR                fold the folders that the micro-batches of a storage consumer wrote
  lag        CHECKPOINT SOURCE_DIR    files read, there and waiting of a consumer, running or stopped
  analytics  SOURCE_DIR OUT_DIR       analytics consumer: window statistics and alert records
  replay     READINGS_CSV OUT_DIR     readings as JSON messages in file order with batch numbers
  drained, recovery, peak-backlog  SAMPLES_CSV    the harness's rules over samples (run, sample_ts, value)
  stats      READINGS_PATH            newest window statistics with the per-device breakdown (JSON)
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from fieldpulse.operators import latency as L
from fieldpulse.operators import recovery as R
from fieldpulse.operators import replay as RP
from fieldpulse.operators import resources as RS
from fieldpulse.operators import windows as W
from fieldpulse.schema import (
    INSTANT_ALERT_THRESHOLD, READING_COLUMNS, REPLAY_BATCH_SIZE, STORAGE_BATCH_SIZE,
    WINDOW_ALERT_THRESHOLD, WINDOW_SECONDS,
)
from fieldpulse.session import build_session, cluster_settings, scratch_path
from fieldpulse.sinks import writers as K
from fieldpulse.sources import files as FS
from fieldpulse.streaming import compaction
from fieldpulse.streaming import jobs as S
from fieldpulse.streaming import offsets as O
from fieldpulse.streaming.buffer import BufferedTable
from fieldpulse.streaming.window_store import WindowStore


def cmd_resources(spark, a) -> int:
    report = RS.resource_by_container(FS.read_stats_samples(spark, a.stats_csv))
    if a.single_object:
        RS.report_object(report).write.mode("overwrite").text(a.out_dir)
    else:
        K.write_report(report, a.out_dir)
    return 0


def cmd_latency(spark, a) -> int:
    row = L.latency_summary(FS.read_latencies(spark, a.latency_file)).first()
    print(row.summary)
    return 0


def cmd_group_lag(spark, a) -> int:
    g = R.group_lag(FS.read_offset_listing(spark, a.listing_file)).first()
    print(f"{g.offset}\t{g.log_end_offset}\t{g.lag}")
    return 0


def _messages(spark, a):
    if a.kafka_servers:  # pragma: no cover - needs the Kafka connector and a broker
        return S.kafka_messages(spark, a.kafka_servers, a.topic, max_offsets_per_trigger=a.max_offsets_per_trigger,
                                min_partitions=a.min_partitions)
    return S.file_messages(spark, a.source_dir, max_files_per_trigger=a.max_files_per_trigger)


def _buffer(spark, a) -> BufferedTable | None:
    return BufferedTable(spark, f"{a.table_dir.rstrip('/')}/table", a.batch_size) if a.batch_size > 1 else None


def _print_counters(row) -> None:
    print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))


def cmd_storage(spark, a) -> int:
    checkpoint = a.checkpoint or scratch_path(spark, "storage-checkpoint")
    also = S.jdbc_rows(a.jdbc_url, a.jdbc_table, {}, a.insert_size) if a.jdbc_url else None
    q = S.run_storage(_messages(spark, a), a.table_dir, checkpoint, available_now=not a.continuous,
                      decode_parallelism=a.decode_parallelism, also=also, buffer=_buffer(spark, a))
    if a.continuous:  # pragma: no cover - runs until stopped
        q.awaitTermination()
    return cmd_counters(spark, a)


def cmd_counters(spark, a) -> int:
    buffer = _buffer(spark, a)
    _print_counters((buffer.counters() if buffer else S.storage_counts(spark, a.table_dir)).first())
    return 0


def cmd_drain(spark, a) -> int:
    print(_buffer(spark, a).drain())
    return 0


def cmd_analytics(spark, a) -> int:
    base = a.checkpoint or scratch_path(spark, "analytics-checkpoint")
    out, size = a.out_dir.rstrip("/"), f"{a.window_seconds} seconds"
    view = S.analytics_view(_messages(spark, a))
    alerts = S.instant_alert_stream(view, instant=a.instant, threshold=a.instant_threshold)
    S.run_to_parquet(alerts, f"{out}/instant_alerts", f"{base}/instant_alerts", available_now=not a.continuous)
    store = WindowStore(spark, f"{out}/windows", size, a.threshold)
    timed = S.with_heartbeat(view) if a.continuous else view       # an idle source closes its windows too
    q = S.run_windows(timed, store, f"{base}/windows", available_now=not a.continuous)
    if a.continuous:  # pragma: no cover - runs until stopped; statistics and alerts are there as windows close
        q.awaitTermination()
    store.finish()
    return 0


def cmd_drained(spark, a) -> int:
    print(_sampled(spark, a, R.drain_stable, stable_needed=a.stable, timeout=a.timeout))
    return 0


def cmd_recovery(spark, a) -> int:
    print(_sampled(spark, a, R.recovery_streak, limit=a.limit, needed=a.needed, horizon=a.horizon))
    return 0


def cmd_peak_backlog(spark, a) -> int:
    print(_sampled(spark, a, R.peak_backlog))
    return 0


def _sampled(spark, a, rule, **parameters) -> str:
    """A rule over a sample file: CSV with a header and columns run, sample_ts, value; one JSON line a run."""
    samples = (spark.read.option("header", True).csv(a.samples_csv)
               .select("run", F.col("sample_ts").cast("timestamp_ntz"), F.col("value").cast("long")))
    return "\n".join(rule(samples, **parameters).orderBy("run").toJSON().collect())     # a row for each run


def cmd_lag(spark, a) -> int:
    g = R.group_lag(O.file_lag(spark, a.checkpoint, a.source_dir)).first()
    print(f"{g.offset}\t{g.log_end_offset}\t{g.lag}")
    return 0


def cmd_fold(spark, a) -> int:
    m = compaction.fold(spark, a.table_dir)
    print(f"segments={len(m.segments)} upto={m.upto}")
    return 0


def cmd_replay(spark, a) -> int:
    batches = RP.replay_files(FS.read_readings_csv(spark, a.readings_csv), batch_size=a.batch_size)
    # few large files; batch_no and its release time tell when a message is due
    (batches.select("batch_no", "release_offset_s", F.to_json(F.struct(*READING_COLUMNS)).alias("value"))
     .write.mode("overwrite").parquet(a.out_dir))
    return 0


def cmd_stats(spark, a) -> int:
    if a.format == "csv":
        readings = FS.read_readings_csv(spark, a.readings)
    else:
        readings = spark.read.parquet(a.readings)
    readings = readings.withColumn("arrival_ts", F.col(a.time_column))
    nested = W.window_stats_nested(readings, f"{a.window_seconds} seconds", a.threshold)
    row = W.latest_stats_document(nested).first()
    print(row.stats if row else "null")
    return 0


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldpulse", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--master", default=None, help="Spark master (default local[$BENCH_CPUS or 8])")
    p.add_argument("--input-gb", type=float, help="size of the input: sets shuffle partitions and file splits for it")
    sub = p.add_subparsers(dest="command", required=True)

    r = sub.add_parser("resources")
    r.add_argument("stats_csv")
    r.add_argument("out_dir")
    r.add_argument("--single-object", action="store_true", help="one JSON object keyed by container")
    r.set_defaults(fn=cmd_resources)

    lt = sub.add_parser("latency")
    lt.add_argument("latency_file")
    lt.set_defaults(fn=cmd_latency)

    g = sub.add_parser("group-lag")
    g.add_argument("listing_file")
    g.set_defaults(fn=cmd_group_lag)

    def source(parser) -> None:
        parser.add_argument("--kafka-servers", help="read a topic instead of SOURCE_DIR")
        parser.add_argument("--topic", default="field-readings")
        parser.add_argument("--max-offsets-per-trigger", type=int, help="Kafka: messages in a micro-batch")
        parser.add_argument("--min-partitions", type=int, help="Kafka: tasks per micro-batch without a shuffle")
        parser.add_argument("--max-files-per-trigger", type=int)
        parser.add_argument("--checkpoint")
        parser.add_argument("--continuous", action="store_true")

    st = sub.add_parser("storage")
    st.add_argument("source_dir", nargs="?")
    st.add_argument("table_dir")
    source(st)
    st.add_argument("--batch-size", type=int, default=1,
                    help="rows of an insert into the table; more than 1: the rest waits in a buffer")
    st.add_argument("--insert-size", type=int, default=STORAGE_BATCH_SIZE, help="rows of an insert into a database")
    st.add_argument("--jdbc-url", help="also insert accepted readings into this database")
    st.add_argument("--jdbc-table", default="readings")
    st.add_argument("--decode-parallelism", type=int)
    st.set_defaults(fn=cmd_storage)
    for name, fn, size in (("drain", cmd_drain, STORAGE_BATCH_SIZE), ("counters", cmd_counters, 1)):
        dr = sub.add_parser(name)
        dr.add_argument("table_dir")
        dr.add_argument("--batch-size", type=int, default=size, help="as given to storage")
        dr.set_defaults(fn=fn)
    lg = sub.add_parser("lag")
    lg.add_argument("checkpoint")
    lg.add_argument("source_dir")
    lg.set_defaults(fn=cmd_lag)
    fo = sub.add_parser("fold")
    fo.add_argument("table_dir")
    fo.set_defaults(fn=cmd_fold)
    rules = {}
    for name, fn in (("drained", cmd_drained), ("recovery", cmd_recovery), ("peak-backlog", cmd_peak_backlog)):
        rules[name] = sub.add_parser(name)
        rules[name].add_argument("samples_csv")
        rules[name].set_defaults(fn=fn)
    rules["drained"].add_argument("--stable", type=int, default=3, help="samples in a row that equal the one before")
    rules["drained"].add_argument("--timeout", type=int, help="samples after which waiting ends")
    rules["recovery"].add_argument("--limit", type=int, default=5)
    rules["recovery"].add_argument("--needed", type=int, default=10, help="samples in a row within the limit")
    rules["recovery"].add_argument("--horizon", type=int, default=180)
    an = sub.add_parser("analytics")
    an.add_argument("source_dir", nargs="?")
    an.add_argument("out_dir")
    source(an)
    an.add_argument("--window-seconds", type=int, default=WINDOW_SECONDS)
    an.add_argument("--threshold", type=float, default=WINDOW_ALERT_THRESHOLD)
    an.add_argument("--instant", action="store_true")
    an.add_argument("--instant-threshold", type=float, default=INSTANT_ALERT_THRESHOLD)
    an.set_defaults(fn=cmd_analytics)

    rp = sub.add_parser("replay")
    rp.add_argument("readings_csv")
    rp.add_argument("out_dir")
    rp.add_argument("--batch-size", type=int, default=REPLAY_BATCH_SIZE)
    rp.set_defaults(fn=cmd_replay)

    sp = sub.add_parser("stats")
    sp.add_argument("readings")
    sp.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    sp.add_argument("--time-column", default="timestamp", help="column holding the arrival time")
    sp.add_argument("--window-seconds", type=int, default=WINDOW_SECONDS)
    sp.add_argument("--threshold", type=float, default=WINDOW_ALERT_THRESHOLD)
    sp.set_defaults(fn=cmd_stats)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = build_parser().parse_args(argv)
    if spark is None:
        spark = build_session(master=a.master, extra=cluster_settings(int(a.input_gb * 1e9)) if a.input_gb else None)
    return a.fn(spark, a)


if __name__ == "__main__":  # pragma: no cover
    sys.exit(main())
