import os

from pyspark.sql import functions as F

from fieldpulse.operators import windows as W
from fieldpulse.plans.catalog import dealt_stream
from fieldpulse.sources import adapters as A
from fieldpulse.streaming import jobs as S
from fieldpulse.streaming.window_store import WindowStore

SF = "/root/testdata/sf0.001"


def _write_slices(spark, ev, folder, bounds):
    for i, (lo, hi) in enumerate(bounds):
        part = ev.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
        part.coalesce(1).write.parquet(os.path.join(folder, f"slice={i}"))


def test_window_stream_twin_and_restart(spark, scratch):
    ev = A.events(spark, SF)
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    slices = [("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-02-01")]
    # first run sees two slices, then stops; the restart from the checkpoint sees the third
    _write_slices(spark, ev, os.path.join(src, "a"), slices[:2])
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    schema = ev.schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        stats = S.window_stats_stream(A.readings(stream), "1 day", 50.0, delay="0 seconds")
        return S.run_to_parquet(stats, out, ck, mode="append")

    run()
    first = spark.read.parquet(out).count()
    _write_slices(spark, ev, os.path.join(src, "b"), slices[2:])
    run()
    got = {r.window_start: r for r in spark.read.parquet(out).collect()}
    batch = W.window_global_stats(A.readings(ev), "1 day", 50.0)
    max_ts = ev.agg(F.max("ts")).first()[0]
    expect = {r.window_start: r for r in batch.collect() if r.window_end <= max_ts}
    assert first < len(got)
    assert set(got) == set(expect)                     # no window lost or doubled across the restart
    for k, r in expect.items():
        assert got[k]["count"] == r["count"] and abs(got[k].avg_temperature - r.avg_temperature) < 1e-9


def test_fan_out_two_consumers(spark, scratch):
    ev = A.events(spark, SF)
    src = os.path.join(scratch, "msgs")
    A.messages(ev).select("value").write.text(src)
    stream = S.file_messages(spark, src)
    one, two = os.path.join(scratch, "one"), os.path.join(scratch, "two")
    S.run_storage(stream, one, os.path.join(scratch, "ck-storage"))
    # a second, independent consumer of the same folder with its own checkpoint
    S.run_storage(stream, two, os.path.join(scratch, "ck-storage-2"))
    bad = ev.where(F.col("event_id") % 97 == 0).count()
    for path in (one, two):
        assert S.rejected_messages(spark, path).count() == bad
        got = S.stored_readings(spark, path)
        assert got.count() == ev.count() - bad and got.where("received_at IS NULL").count() == 0


def test_counts_of_more_batches_than_progress_keeps(spark, scratch):
    src = os.path.join(scratch, "msgs")
    rows = [('{"timestamp":"2024-01-01 00:00:00","device_id":"d%d"}' % i,) for i in range(115)] + [("nope",)]
    spark.createDataFrame(rows, "value string").repartition(116, "value").write.text(src)
    files = len([f for f in os.listdir(src) if f.endswith(".txt")])
    path = os.path.join(scratch, "table")
    q = S.run_storage(S.file_messages(spark, src, max_files_per_trigger=1).where("value <> ''"), path,
                      os.path.join(scratch, "ck"))
    # one file each; more micro-batches than the progress list may hold
    assert S.storage_counts(spark, path).first().asDict() == {"received": 116, "stored": 115, "errors": 1}
    assert q.lastProgress["batchId"] + 1 >= files // 2


def test_a_batch_that_runs_again_replaces_its_output(spark, scratch):
    path = os.path.join(scratch, "table")
    batch = spark.createDataFrame([('{"timestamp":"2024-01-01 00:00:00","device_id":"d"}',), ("x",)], "value string")
    write = S.storage_batches(path)
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert S.storage_counts(spark, path).first().asDict() == {"received": 4, "stored": 2, "errors": 2}
    assert S.stored_readings(spark, path).count() == 2


def test_analytics_streams(spark, scratch):
    ev = A.events(spark, SF)
    src = os.path.join(scratch, "msgs")
    A.messages(ev).select("value").repartition(5).write.text(src)
    view = S.analytics_view(S.file_messages(spark, src, max_files_per_trigger=1))
    alerts = S.instant_alert_stream(view, instant=True, threshold=40.0)
    S.run_to_parquet(alerts, os.path.join(scratch, "alerts"), os.path.join(scratch, "ck-a"))
    got = spark.read.parquet(os.path.join(scratch, "alerts"))
    good = ev.where(F.col("event_id") % 97 != 0)
    assert got.count() == good.where(F.col("value") > 40).count()
    assert got.where("e2e_latency_ms IS NULL").count() == 0
    # on arrival time every usable message is in some window, the last one included
    store = WindowStore(spark, os.path.join(scratch, "windows"), "1 hour", 50.0)
    S.run_windows(view, store, os.path.join(scratch, "ck-s"))
    store.finish()
    store.finish()                                              # each window once
    assert store.stats().agg(F.sum("count")).first()[0] == good.count()


def _stream_rows(spark, folder, batches):
    """Write each batch as its own file (one micro-batch each with maxFilesPerTrigger=1)."""
    import time as _t
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "t string, device_id string, temperature double")
        df.coalesce(1).write.json(os.path.join(folder, f"b{i}"))
        _t.sleep(1.1)      # distinct modification times keep the file order


def _json_stream(spark, folder):
    r = (spark.readStream.schema("t string, device_id string, temperature double")
         .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(folder))
    return r.select(F.col("t").cast("timestamp").alias("event_ts"), "device_id", "temperature")


def test_event_time_late_rows_dropped_and_empty_windows(spark, scratch):
    # A row is late when its window was already closed by the previous batch's
    # watermark; such rows are dropped and never reopen an emitted window.
    src = os.path.join(scratch, "ev")
    _stream_rows(spark, src, [
        [("2024-01-01 00:00:01", "a", 10.0), ("2024-01-01 00:00:12", "a", 20.0)],
        [("2024-01-01 00:00:45", "a", 30.0)],                     # watermark 00:00:40 after this batch
        [("2024-01-01 00:00:55", "a", 40.0)],                     # [0,10) and [10,20) are emitted here
        [("2024-01-01 00:00:03", "b", 99.0), ("2024-01-01 00:01:30", "a", 50.0)],   # 00:00:03 is late
    ])
    stats = S.window_stats_stream(_json_stream(spark, src), "10 seconds", 50.0, delay="5 seconds", time_col="event_ts")
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    q = S.run_to_parquet(stats, out, ck, mode="append")
    rows = spark.read.parquet(out).collect()
    got = {str(r.window_start): r for r in rows}
    assert len(rows) == len(got)                             # every window emitted once
    assert got["2024-01-01 00:00:00"]["count"] == 1          # the late 99.0 never joined the window
    assert got["2024-01-01 00:00:00"].max_temperature == 10.0
    assert "2024-01-01 00:00:20" not in got                  # empty windows are not emitted
    assert set(got) == {"2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:40",
                        "2024-01-01 00:00:50"}               # [01:30,01:40) stays open (append)
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_windows_and_alerts_equal_the_batch(spark, scratch):
    ev = A.events(spark, SF)
    store = WindowStore(spark, os.path.join(scratch, "windows"), "1 hour", 50.0, in_order=False)
    S.run_windows(A.readings(dealt_stream(ev, "event_id", 5)), store, os.path.join(scratch, "ck"))
    assert store.stats() is None                                # rows of all times: nothing may close before the end
    store.finish()
    batch = W.window_global_stats(A.readings(ev), "1 hour", 50.0)
    assert sorted(map(tuple, store.stats().collect())) == sorted(map(tuple, batch.collect()))
    rows = store.alerts()
    assert rows.count() == batch.where("alert_triggered").count() > 0
    assert rows.where("window_size_s = 3600 AND temperature > 50").count() == rows.count()
