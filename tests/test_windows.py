from pyspark.sql import functions as F

from fieldpulse.operators import windows as W


def _readings(spark, rows):
    df = spark.createDataFrame(rows, "t string, device_id string, temperature double")
    return df.select(F.col("t").cast("timestamp_ntz").alias("arrival_ts"), "device_id", "temperature")


ROWS = [("2024-01-01 00:00:01", "a", 40.0), ("2024-01-01 00:00:02", "a", 61.0),
        ("2024-01-01 00:00:03", "b", 52.5), ("2024-01-01 00:00:04", "b", float("nan")),
        ("2024-01-01 00:00:05", "c", None),
        # gap of two empty windows
        ("2024-01-01 00:00:31", "a", 10.0), ("2024-01-01 00:00:39", "b", 20.0)]


def test_global_stats_and_gaps(spark):
    s = W.window_global_stats(_readings(spark, ROWS), "10 seconds", 50.0).orderBy("window_start").collect()
    assert len(s) == 2                                   # empty windows give no rows
    assert s[0]["count"] == 3 and abs(s[0].avg_temperature - 51.166666666666664) < 1e-12
    assert s[0].alert_triggered and s[0].min_temperature == 40.0 and s[0].max_temperature == 61.0
    assert not s[1].alert_triggered and s[1]["count"] == 2
    assert str(s[0].window_start) == "2024-01-01 00:00:00" and str(s[0].window_end) == "2024-01-01 00:00:10"


def test_strict_threshold(spark):
    s = W.window_global_stats(_readings(spark, [("2024-01-01 00:00:01", "x", 50.0)]), "10 seconds", 50.0).first()
    assert not s.alert_triggered


def test_nested_and_flat(spark):
    r = _readings(spark, ROWS)
    nested = W.window_stats_nested(r, "10 seconds", 50.0).orderBy("window_start").collect()
    first = nested[0]
    assert first["count"] == 3 and first.per_device["a"]["count"] == 2
    assert first.per_device["a"]["avg"] == 50.5 and first.per_device["b"]["max"] == 52.5
    flat = W.window_stats_flat(r, "10 seconds", 50.0)
    assert flat.count() == 4
    single = {x.window_start: x.avg_temperature for x in W.window_global_stats(r, "10 seconds").collect()}
    for x in flat.collect():
        assert abs(x.avg_temperature - single[x.window_start]) < 1e-9


def test_device_stats_rounding(spark):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:02", "a", 1.01), ("2024-01-01 00:00:03", "a", 1.005)]
    d = W.window_device_stats(_readings(spark, rows), "10 seconds").first()
    import math
    from decimal import Decimal
    # exact decimal sum, one division, then half-up on the binary value
    mean = float(Decimal("1.0") + Decimal("1.01") + Decimal("1.005")) / 3
    assert d["avg"] == math.floor(mean * 100 + 0.5) / 100 and d["min"] == 1.0 and d["max"] == 1.01


def test_latest_window(spark):
    r = _readings(spark, ROWS)
    last = W.latest_window(W.window_global_stats(r, "10 seconds")).collect()
    assert len(last) == 1 and str(last[0].window_start) == "2024-01-01 00:00:30" and last[0].avg_temperature == 15.0
    empty = W.latest_window(W.window_global_stats(r.where("1 = 0"), "10 seconds")).collect()
    assert empty == []


def test_window_start_offset(spark):
    rows = [("2024-01-01 00:00:03", "a", 1.0), ("2024-01-01 00:00:07", "a", 2.0)]
    s = W.window_global_stats(_readings(spark, rows), "10 seconds", 50.0, start="5 seconds").orderBy("window_start")
    got = [(str(r.window_start), r["count"]) for r in s.collect()]
    assert got == [("2023-12-31 23:59:55", 1), ("2024-01-01 00:00:05", 1)]


def test_flat_stats_with_hot_device_and_hot_window(spark):
    import datetime as dt
    import random
    from decimal import Decimal

    rnd = random.Random(21)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        device = "hot" if hot else f"d{rnd.randint(0, 40)}"
        second = rnd.randint(0, 9) if hot else rnd.randint(0, 299)       # the hot device sits in one window
        rows.append(((base + dt.timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S"), device,
                     round(rnd.uniform(0, 90), 2)))
    df = _readings(spark, rows).repartition(6)
    got = {(str(r.window_start), r.device_id): r for r in W.window_stats_flat(df, "10 seconds", 50.0).collect()}
    per_window, per_device = {}, {}
    for t, d, v in rows:
        w = t[:-1] + "0"
        per_window.setdefault(w, []).append(v)
        per_device.setdefault((w, d), []).append(v)
    assert len(got) == len(per_device)
    for (w, d), vals in per_device.items():
        r = got[(w, d)]
        wvals = per_window[w]
        mean = float(sum(Decimal(str(x)) for x in wvals) / len(wvals))
        assert r["count"] == len(wvals) and r.device_count == len(vals)
        assert abs(r.avg_temperature - mean) < 1e-9 and r.alert_triggered == (mean > 50.0)
        assert r.device_min == min(vals) and r.device_max == max(vals)


def test_latest_stats_document(spark):
    import json
    doc = W.latest_stats_document(W.window_stats_nested(_readings(spark, ROWS), "10 seconds", 50.0)).collect()
    assert len(doc) == 1
    d = json.loads(doc[0].stats)
    assert d["count"] == 2 and d["avg_temperature"] == 15.0 and d["threshold"] == 50.0
    assert d["per_device"] == {"a": {"count": 1, "avg": 10.0, "min": 10.0, "max": 10.0},
                               "b": {"count": 1, "avg": 20.0, "min": 20.0, "max": 20.0}}
    assert d["window_start"].startswith("2024-01-01T00:00:30")


def test_the_mean_is_not_cut(spark):
    def stats(*values):
        rows = spark.createDataFrame([("2024-01-01 00:00:01", "d", v) for v in values], "t string, device_id string, temperature double")
        rows = rows.select(F.col("t").cast("timestamp_ntz").alias("arrival_ts"), "device_id", "temperature")
        return (W.window_global_stats(rows).first(), W.window_stats_nested(rows).first(), W.window_device_stats(rows).first())

    for r in stats(50.00004)[:2]:
        assert r.avg_temperature == 50.00004 and r.alert_triggered
    for r in stats(50.0)[:2]:
        assert r.avg_temperature == 50.0 and not r.alert_triggered
    a, b, d = stats(1e15, 1e-7)
    assert a.avg_temperature == b.avg_temperature == (1e15 + 1e-7) / 2 and d["count"] == 2
    a, b, _ = stats(1e300, 1e300)                    # beyond every decimal: the plain mean
    assert a.avg_temperature == b.avg_temperature == 1e300
    a, b, _ = stats(1e-30, 3e-30)
    assert abs(a.avg_temperature - 2e-30) < 1e-40 and abs(b.avg_temperature - 2e-30) < 1e-40
    assert stats(*[0.1] * 10)[0].avg_temperature == 0.1     # exact, whatever the order
