from pyspark.sql import functions as F

from fieldpulse.functions import numeric as N
from fieldpulse.functions import parsing as P
from fieldpulse.functions import timefmt as TF


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


def test_parse_mem_mb(spark):
    assert _one(spark, P.parse_mem_mb, "1GiB / 2GiB") == 1024.0
    assert _one(spark, P.parse_mem_mb, "512KiB / 7.6GiB") == 0.5
    assert _one(spark, P.parse_mem_mb, "47.4MiB / 7.6GiB") == 47.4
    assert _one(spark, P.parse_mem_mb, "1048576B / 1GiB") == 1.0
    assert _one(spark, P.parse_mem_mb, "7") == 0.0


def test_parse_net_mb(spark):
    assert _one(spark, P.parse_net_mb, "1GB / 1MB") == 1025.0
    assert _one(spark, P.parse_net_mb, "88kB / 1.2MB") == 88 / 1024 + 1.2
    assert _one(spark, P.parse_net_mb, "0 / 0") == 0.0


def test_parse_cpu(spark):
    assert _one(spark, P.parse_cpu, " 12.5% ") == 12.5


def test_round2_as_python_rounds(spark):
    assert _one(spark, N.round2, 2.675, "x double") == 2.67    # 2.67499999... in binary
    assert _one(spark, N.round2, 1e18, "x double") == 1e18
    assert _one(spark, N.round2, 1.005, "x double") == 1.0     # 1.00499999... in binary
    assert _one(spark, N.round2, 0.125, "x double") == 0.12    # exact tie goes to even
    assert _one(spark, N.round2, -1.234, "x double") == -1.23


def test_loss(spark):
    df = spark.createDataFrame([(0, 5), (100, 100), (100, 110), (3, 2)], "s long, r long")
    got = [r[0] for r in df.select(N.loss_pct_text(F.col("s"), F.col("r"))).collect()]
    assert got == ["0.00", "0.00", "-10.00", "33.33"]


def test_clamped_backlog(spark):
    df = spark.createDataFrame([(10, 3, 2), (3, 3, 2)], "r long, s long, b long")
    got = [r[0] for r in df.select(N.clamped_backlog(F.col("r"), F.col("s"), F.col("b"))).collect()]
    assert got == [5, 0]


def test_py_repr2(spark):
    df = spark.createDataFrame([(12.5,), (30.0,), (47.41,), (0.1,)], "x double")
    assert [r[0] for r in df.select(N.py_repr2(F.col("x"))).collect()] == ["12.5", "30.0", "47.41", "0.1"]


def test_published_at(spark):
    df = spark.createDataFrame(
        [("2026-07-11T22:11:57.000Z",), ("2026-07-11T22:11:57",), ("PLACEHOLDER",), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(P.parse_published_at(F.col("x"))).collect()]
    assert str(got[0]) == "2026-07-11 22:11:57" and got[0] == got[1]
    assert got[2:] == [None, None, None]


def test_latency_and_formats(spark):
    df = spark.createDataFrame([("2026-07-11T22:11:57.000Z", "2026-07-11 22:11:58.971")], "p string, a string")
    row = df.select(
        TF.e2e_latency_ms(P.parse_published_at(F.col("p")), F.col("a").cast("timestamp_ntz")).alias("lat"),
        TF.iso_format(F.col("a").cast("timestamp_ntz")).alias("iso"),
        TF.iso_format(F.lit("2026-07-11 22:11:58").cast("timestamp_ntz")).alias("iso0"),
        TF.stamp_second(F.col("a").cast("timestamp_ntz")).alias("st"),
        TF.batch_stamp(F.col("a").cast("timestamp_ntz")).alias("bs"),
        TF.latency_default(F.lit(None).cast("double")).alias("d"),
    ).first()
    assert abs(row.lat - 1971.0) < 1e-9
    assert row.iso == "2026-07-11T22:11:58.971000+00:00"
    assert row.iso0 == "2026-07-11T22:11:58+00:00"
    assert row.st == "2026-07-11T22:11:58.000Z"
    assert row.bs == "20260711_221158"
    assert row.d == 0.0


def test_cluster_settings():
    from fieldpulse.session import cluster_settings
    s = cluster_settings(100 * 2 ** 40)
    assert int(s["spark.sql.shuffle.partitions"]) == 100 * 2 ** 40 // (256 << 20)
    assert cluster_settings(1)["spark.sql.shuffle.partitions"] == "200"
