"""Lag from checkpoints and progress, folded tables, nested statistics in parts."""
import os

from pyspark.sql import functions as F

from fieldpulse import cli
from fieldpulse.operators import recovery as R
from fieldpulse.operators import windows as W
from fieldpulse.sources import adapters as A
from fieldpulse.streaming import compaction
from fieldpulse.streaming import jobs as S
from fieldpulse.streaming import offsets as O

SF = "/root/testdata/sf0.001"


def put(spark, folder, names):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(os.path.join(folder, f".{n}"), "w") as f:
            f.write('{"timestamp":"2024-01-01 00:00:00","device_id":"%s","temperature":70}\nnope\n' % n)
        os.rename(os.path.join(folder, f".{n}"), os.path.join(folder, f"{n}.json"))


def lag(spark, ck, src):
    return tuple(R.group_lag(O.file_lag(spark, ck, src)).first())


def test_lag_of_a_stream_stopped_and_resumed(spark, scratch, capsys):
    src, ck, out = (os.path.join(scratch, n) for n in ("in", "ck", "out"))
    put(spark, src, "abc")
    stream = S.file_messages(spark, src, max_files_per_trigger=1)
    S.run_storage(stream, out, ck)
    assert lag(spark, ck, src) == (3, 3, 0)
    put(spark, src, "defgh")                                     # while it is stopped
    assert lag(spark, ck, src) == (3, 8, 5)
    assert cli.main(["lag", ck, src], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "3\t8\t5"
    q = stream.writeStream.foreachBatch(S.storage_batches(out)).option("checkpointLocation", ck).start()
    try:
        q.processAllAvailable()                                  # resumed, and running
        assert q.isActive and lag(spark, ck, src) == (8, 8, 0)
        put(spark, src, [f"x{i}" for i in range(9)])             # the source's log is compacted on the way
        q.processAllAvailable()
        assert lag(spark, ck, src) == (17, 17, 0)
    finally:
        q.stop()
    assert S.storage_counts(spark, out).first().received == 34


def test_lag_of_a_topic_from_its_progress(spark):
    progress = {"sources": [{"description": "KafkaV2[Subscribe[r]]", "endOffset": {"r": {"0": 70, "1": 5}},
                             "latestOffset": {"r": {"0": 100, "1": 5}}}]}
    rows = O.progress_lag(spark, progress)
    assert sorted(map(tuple, rows.collect())) == [("r", 0, 70, 100, 30), ("r", 1, 5, 5, 0)]
    assert tuple(R.group_lag(rows).first()) == (75, 105, 30)
    assert tuple(R.group_lag(O.progress_lag(spark, None)).first()) == (0, 0, 0)


def test_open_windows_from_the_state(spark, scratch):
    src, ck = os.path.join(scratch, "in"), os.path.join(scratch, "ck")
    rows = [("2024-01-01 00:00:05", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-01 02:30:00", "b", 3.0)]
    spark.createDataFrame(rows, "t string, device_id string, temperature double").coalesce(1).write.json(src)
    stream = (spark.readStream.schema("t string, device_id string, temperature double").json(src)
              .select(F.col("t").cast("timestamp").alias("arrival_ts"), "device_id", "temperature"))
    S.run_to_parquet(S.window_stats_stream(stream, "1 hour", 50.0, "0 seconds"), os.path.join(scratch, "out"), ck)
    assert [str(r.window_start) for r in O.window_state(spark, ck).collect()] == ["2024-01-01 02:00:00"]


def contents(spark, path):
    return (sorted(r.device_id for r in S.stored_readings(spark, path).collect()),
            sorted(r.value for r in S.rejected_messages(spark, path).collect()), S.storage_counts(spark, path).first())


def test_folding_changes_nothing(spark, scratch, monkeypatch, capsys):
    path = os.path.join(scratch, "t")
    write = S.storage_batches(path)

    def batch(n):
        return spark.createDataFrame([('{"timestamp":"2024-01-01 00:00:00","device_id":"d%d"}' % (3 * n + k),) for k in range(3)]
                                     + ([(f"bad{n}",)] if n % 2 else []), "value string")

    for n in range(4):
        write(batch(n), n)
    before = contents(spark, path)
    assert compaction.fold(spark, path).upto == 2                 # not the newest: it may run again
    assert contents(spark, path) == before
    write(batch(3), 3)
    assert contents(spark, path) == before
    assert compaction.fold(spark, path) == compaction.newest(spark, path)     # nothing new to fold
    reader, n_rows = S.stored_readings(spark, path), len(before[0])            # started before the next fold
    for n in range(4, 7):
        write(batch(n), n)
    before = contents(spark, path)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:                              # dies between the segment and the manifest
        m.setattr(compaction, "remove_path", die)
        real = spark.createDataFrame
        m.setattr(spark, "createDataFrame", die)
        try:
            compaction.fold(spark, path)
        except RuntimeError:
            pass
        m.setattr(spark, "createDataFrame", real)
    assert contents(spark, path) == before
    assert cli.main(["fold", path], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "segments=2 upto=5"
    assert contents(spark, path) == before
    assert reader.count() == n_rows
    left = {int(d.split("=")[1]) for d in os.listdir(f"{path}/counts")}
    assert left == {3, 4, 5, 6}                                   # those folded before are gone


def test_nested_statistics_in_parts(spark):
    ev = A.events(spark, SF)
    readings = A.readings(ev)
    flat = W.window_stats_flat(readings, "7 days", 50.0)
    most = flat.groupBy("window_start").count().agg(F.max("count")).first()[0]
    for size in (1, 7, 10_000):
        parts = W.window_stats_nested_parts(readings, "7 days", 50.0, part_devices=size)
        got = W.exploded(parts)
        assert sorted(map(tuple, got.select(flat.columns).collect())) == sorted(map(tuple, flat.collect()))
        held = parts.agg(F.max(F.size("per_device"))).first()[0]
        assert held <= max(6 * size, 12) and (size > most or held < most)       # no row holds all devices
        assert parts.where("part >= parts").count() == 0
