from pyspark.sql import functions as F

from fieldpulse.operators import recovery as R
from fieldpulse.sources.files import parse_offset_listing


def _series(spark, values, run="r"):
    rows = [(run, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, sample_ts long, value long")


def test_recovery_streak(spark):
    r = R.recovery_streak(_series(spark, [9, 5, 5, 6, 5, 5, 5]), limit=5, needed=3).first()
    assert r.recovery_index == 6 and r.recovery_s == "7"
    never = R.recovery_streak(_series(spark, [9, 9, 9]), limit=5, needed=3).first()
    assert never.recovery_index is None and never.recovery_s == "180+"


def test_drain_stable(spark):
    d = R.drain_stable(_series(spark, [1, 2, 2, 2, 2])).first()
    assert d.drained_index == 4 and d.drained_value == 2
    never = R.drain_stable(_series(spark, [1, 2, 3])).first()
    assert never.drained_index is None and never.timed_out
    assert not d.timed_out
    assert R.drain_stable(_series(spark, [1, 2, 2, 2, 2]), timeout=4).first().timed_out   # index 4 is too late


def test_peak_and_first_recovery(spark):
    s = _series(spark, [3, 8, 2, 7])
    assert R.peak_backlog(s).first().peak_backlog == 8
    assert R.peak_backlog(s, phase_start=F.lit(2)).first().peak_backlog == 7
    ts = spark.createDataFrame([("r", "2024-01-01 00:00:00", 1), ("r", "2024-01-01 00:00:05", 9)],
                               "run string, t string, value long").select(
        "run", F.col("t").cast("timestamp_ntz").alias("sample_ts"), "value")
    f = R.first_recovery(ts, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("value") > 3).first()
    assert f.recovery_seconds == 5 and f.recovery_s == "5"
    none = R.first_recovery(ts, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("value") > 30).first()
    assert none.recovery_s == "120+"


LISTING = """
Consumer group 'field-storage' has no active members.

GROUP              TOPIC                   PARTITION  CURRENT-OFFSET  LOG-END-OFFSET  LAG   CONSUMER-ID  HOST  CLIENT-ID
field-storage field-readings 0          10              15              5     -            -     -
field-storage field-readings 1          -               7               -     -            -     -
field-storage field-readings x          3               3               0     -            -     -
"""


def _listing(spark, text, src="f"):
    return spark.createDataFrame([(src, line) for line in text.splitlines()], "source string, value string")


def test_group_lag(spark):
    rows = parse_offset_listing(_listing(spark, LISTING))
    assert rows.count() == 2
    g = R.group_lag(rows).first()
    assert (g.offset, g.log_end_offset, g.lag) == (10, 22, 5)
    none = R.group_lag(parse_offset_listing(_listing(spark, "Error: nothing here"))).first()
    assert (none.offset, none.log_end_offset, none.lag) == (0, 0, 0)
    only_dash = LISTING.replace(" 10 ", " -  ")
    g2 = R.group_lag(parse_offset_listing(_listing(spark, only_dash))).first()
    assert g2.offset == 22          # no committed offset: falls back to the log end


def test_snapshots(spark):
    view = spark.createDataFrame([("r", 1, True), ("r", 5, True), ("r", 6, False), ("r", 7, True)],
                                 "run string, t long, is_valid boolean")
    snap = R.snapshot_counts(view, "t", F.lit(4), F.lit(10), ["run"], 1)
    o = R.outage_messages(snap, ["run"]).first()
    assert (o.db_delta, o.metrics_delta, o.messages_during) == (2, 3, 3)
    assert R.received_max(snap, ["run"]).first().received == 3


def _first_slice(values, width, holds):
    """The last index of the first slice of ``width`` values that satisfies ``holds``."""
    ends = [e for e in range(width, len(values) + 1) if holds(values[e - width:e])]
    return ends[0] - 1 if ends else None


def test_streaks_match_the_definition_with_a_hot_run(spark, monkeypatch):
    import random
    monkeypatch.setattr(R, "BLOCK_ROWS", 100)                # the hot run spans many blocks
    rnd = random.Random(11)
    series = {"hot": [rnd.choice([1, 1, 2, 6, 7]) for _ in range(3000)]}
    for r in range(12):
        series[f"r{r}"] = [rnd.choice([2, 2, 3, 9]) for _ in range(rnd.randint(1, 150))]
    rows = [(run, i, v) for run, vals in series.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "run string, sample_ts long, value long").repartition(4)
    drains = {r.run: r.drained_index for r in R.drain_stable(df).collect()}
    streaks = {r.run: r.recovery_index for r in R.recovery_streak(df, limit=5, needed=10).collect()}
    assert drains == {run: _first_slice(v, 4, lambda s: len(set(s)) == 1) for run, v in series.items()}
    assert streaks == {run: _first_slice(v, 10, lambda s: max(s) <= 5) for run, v in series.items()}
