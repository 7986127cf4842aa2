"""Property tests: the Spark expressions against small Python models on generated inputs."""


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldpulse.functions import numeric as N
from fieldpulse.functions import parsing as P

MEM_UNITS = [("GiB", 1024.0, True), ("MiB", 1.0, True), ("KiB", 1024.0, False), ("B", 1048576.0, False)]
NET_UNITS = [("GB", 1024.0, True), ("MB", 1.0, True), ("kB", 1024.0, False), ("B", 1048576.0, False)]


def _model_scaled(text, units):
    for suffix, factor, multiply in units:
        if text.endswith(suffix):
            x = float(text[: -len(suffix)])
            return x * factor if multiply else x / factor
    return 0.0


def model_mem(v):
    return _model_scaled(v.strip().split("/")[0].strip(), MEM_UNITS)


def model_net(v):
    total = 0.0
    for part in v.split("/"):
        total += _model_scaled(part.strip(), NET_UNITS)
    return total


numbers = st.decimals(min_value=0, max_value=100000, places=2, allow_nan=False).map(str)
mem_text = st.builds(lambda n, u, lim: f"{n}{u} / {lim}GiB", numbers, st.sampled_from([u for u, _, _ in MEM_UNITS] + [""]),
                     st.integers(1, 64))
net_text = st.builds(lambda a, ua, b, ub: f"{a}{ua} / {b}{ub}", numbers, st.sampled_from(["GB", "MB", "kB", "B", ""]),
                     numbers, st.sampled_from(["GB", "MB", "kB", "B", ""]))
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(mem_text, min_size=1, max_size=40), st.lists(net_text, min_size=1, max_size=40))
def test_parsers_match_model(spark, mems, nets):
    df = spark.createDataFrame([(m,) for m in mems], "x string")
    got = [r[0] for r in df.select(P.parse_mem_mb(F.col("x"))).collect()]
    assert got == [model_mem(m) for m in mems]
    df = spark.createDataFrame([(n,) for n in nets], "x string")
    got = [r[0] for r in df.select(P.parse_net_mb(F.col("x"))).collect()]
    assert got == [model_net(n) for n in nets]


@SETTINGS
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False), min_size=1,
                max_size=60))
def test_round2_and_text_match_model(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select(N.round2(F.col("x")).alias("r"), N.py_repr2(F.col("x")).alias("t")).collect()
    for x, r in zip(xs, rows):
        assert r.r == round(x, 2)
        # two decimals with one trailing zero dropped (12.50 -> 12.5, 30.00 -> 30.0)
        text = "%.2f" % x
        assert r.t == (text[:-1] if text.endswith("0") else text)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10 ** 6), st.integers(0, 10 ** 6)), min_size=1, max_size=40))
def test_loss_matches_model(spark, pairs):
    df = spark.createDataFrame(pairs, "s long, r long")
    rows = df.select(N.loss_pct(F.col("s"), F.col("r")).alias("p"),
                     N.clamped_backlog(F.col("s"), F.col("r"), 3).alias("b")).collect()
    for (s, r), row in zip(pairs, rows):
        assert row.p == (0.0 if s <= 0 else (s - r) * 100.0 / s)
        assert row.b == max(s - r - 3, 0)
