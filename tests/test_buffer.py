"""The buffer between micro-batches: full inserts, carried rows, drains and re-runs."""
import os

from pyspark.sql import functions as F

from fieldpulse import cli
from fieldpulse.plans.catalog import dealt_stream
from fieldpulse.sources import adapters as A
from fieldpulse.streaming import jobs as S
from fieldpulse.streaming.buffer import BufferedTable

SF = "/root/testdata/sf0.001"


def message(i):
    return '{"timestamp":"2024-01-01 00:00:00","device_id":"d%d"}' % i


def batch(spark, ids, bad=0):
    rows = [(message(i),) for i in ids] + [("nope",)] * bad
    return spark.createDataFrame(rows, "value string").repartition(2)


def devices(df):
    return [] if df is None else [r.device_id for r in df.orderBy("seq").collect()]


def counters(buffer):
    r = buffer.counters().first()
    return r.received, r.stored, r.errors, r.buffered, r.batches_flushed


def test_rows_are_carried_until_a_batch_is_full(spark, scratch):
    path = os.path.join(scratch, "t")
    buffer = BufferedTable(spark, f"{path}/table", 10)
    write = S.storage_batches(path, buffer=buffer)
    assert buffer.drain() == 0 and buffer.table() is None and counters(buffer) == (0, 0, 0, 0, 0)
    write(batch(spark, range(4), bad=2), 0)                       # 4 wait
    assert counters(buffer) == (6, 0, 2, 4, 0) and buffer.waiting().count() == 4
    write(batch(spark, range(4, 9)), 1)                           # 9 wait
    write(batch(spark, [], bad=1), 2)                             # nothing accepted
    assert counters(buffer) == (12, 0, 3, 9, 0)
    write(spark.createDataFrame([], "value string"), 2)           # nothing at all, planned away
    assert counters(buffer) == (11, 0, 2, 9, 0)
    write(batch(spark, [], bad=1), 2)
    write(batch(spark, range(9, 34)), 3)                          # 34: three inserts, 4 wait
    assert counters(buffer) == (37, 30, 3, 4, 3)
    table = buffer.table()
    assert [r["count"] for r in table.groupBy("insert_no").count().orderBy("insert_no").collect()] == [10, 10, 10]
    got = devices(table) + devices(buffer.waiting())
    assert sorted(got) == sorted(f"d{i}" for i in range(34))
    assert set(got[:9]) == {f"d{i}" for i in range(9)}            # the carried rows go first
    assert [r.seq for r in table.orderBy("seq").collect()] == list(range(30))
    # the buffers of old micro-batches and the rows moved to the table are gone
    assert not os.path.exists(f"{path}/table/parts/is_inserted=false/batch_id=1")
    assert not os.path.exists(f"{path}/rows/is_valid=true/batch_id=3")


def test_a_batch_that_runs_again_changes_nothing(spark, scratch):
    path = os.path.join(scratch, "t")
    buffer = BufferedTable(spark, f"{path}/table", 10)
    write = S.storage_batches(path, buffer=buffer)
    batches = [batch(spark, range(7)), batch(spark, range(7, 18)), batch(spark, range(18, 25))]
    for n, b in enumerate(batches):
        write(b, n)
        first = (counters(buffer), sorted(devices(buffer.table())), sorted(devices(buffer.waiting())))
        write(b, n)                                               # its commit was lost
        again = BufferedTable(spark, f"{path}/table", 10)         # in another session
        assert (counters(again), sorted(devices(again.table())), sorted(devices(again.waiting()))) == first
    assert first[0] == (25, 20, 0, 5, 2)


def test_drain_between_batches(spark, scratch):
    path = os.path.join(scratch, "t")
    buffer = BufferedTable(spark, f"{path}/table", 10)
    write = S.storage_batches(path, buffer=buffer)
    write(batch(spark, range(13)), 0)
    assert buffer.drain() == 3 and buffer.drain() == 0
    assert counters(buffer) == (13, 13, 0, 0, 2) and buffer.waiting() is None
    write(batch(spark, range(13)), 0)                             # run again after the drain: still each row once
    assert counters(buffer) == (13, 13, 0, 0, 2) and sorted(devices(buffer.table())) == sorted(f"d{i}" for i in range(13))
    write(batch(spark, range(13, 25)), 1)                         # batches count from the drain on
    assert counters(buffer) == (25, 23, 0, 2, 3)
    assert [r["count"] for r in buffer.table().groupBy("insert_no").count().orderBy("insert_no").collect()] == [10, 3, 10]
    assert buffer.drain() == 2 and sorted(devices(buffer.table())) == sorted(f"d{i}" for i in range(25))


def test_a_drain_that_died_is_completed(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "t")
    buffer = BufferedTable(spark, f"{path}/table", 10)
    write = S.storage_batches(path, buffer=buffer)
    write(batch(spark, range(13)), 0)
    monkeypatch.setattr(BufferedTable, "_insert_drained", lambda self, n: None)       # after its intent
    assert buffer.drain() == 3
    monkeypatch.undo()
    write(batch(spark, range(13, 20)), 1)
    assert counters(buffer) == (20, 13, 0, 7, 2)
    assert sorted(devices(buffer.table())) == sorted(f"d{i}" for i in range(13))


def test_stream_with_restart_drains_the_rest(spark, scratch):
    ev = A.events(spark, SF)
    path, ck = os.path.join(scratch, "t"), os.path.join(scratch, "ck")
    good = ev.where(F.col("event_id") % 97 != 0).count()
    stream = A.messages(dealt_stream(ev, "event_id", 4))
    S.run_storage(stream, path, ck, buffer=BufferedTable(spark, f"{path}/table", 150))
    S.run_storage(stream, path, ck, buffer=BufferedTable(spark, f"{path}/table", 150))    # nothing new
    buffer = BufferedTable(spark, f"{path}/table", 150)
    assert counters(buffer) == (ev.count(), good // 150 * 150, ev.count() - good, good % 150, good // 150)
    assert buffer.drain() == good % 150 > 0
    assert buffer.table().count() == good == buffer.table().select("seq").distinct().count()


def test_commands(spark, scratch, capsys):
    src, table = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    batch(spark, range(25), bad=3).write.text(src)
    assert cli.main(["storage", src, table, "--batch-size", "10"], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "received=28 stored=20 errors=3 buffered=5 batches_flushed=2"
    assert cli.main(["drain", table, "--batch-size", "10"], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "5"
    assert cli.main(["counters", table, "--batch-size", "10"], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "received=28 stored=25 errors=3 buffered=0 batches_flushed=3"
