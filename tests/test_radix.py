"""Ranks by bit prefixes against sorting."""
import contextlib
import io
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators.radix import floor_rank_pick, ordered_bits, summary_with_floor_rank

SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
           float("inf"), float("-inf"), 0.1, 1 / 3, 2.0 ** 52, 2.0 ** 53 + 2, 2.0 ** -1022, 2.0 ** 1023, 1000.0, 1000.0000000000001]


def bits_of(x):
    (n,) = struct.unpack("<q", struct.pack("<d", abs(x)))
    return -n if x < 0 else n


def random_doubles(rnd, n):
    out = []
    while len(out) < n:
        (x,) = struct.unpack("<d", rnd.randbytes(8))
        if not math.isnan(x):
            out.append(x)
    return out


def test_bits_are_those_of_the_double(spark):
    rnd = random.Random(2)
    powers = [s * 2.0 ** e * (1 + d * 2.0 ** -52) for e in range(-1022, 1024, 3) for s in (1, -1) for d in (0, 1)]
    values = SPECIAL + random_doubles(rnd, 3000) + powers + [math.nextafter(2.0 ** e, 0) for e in range(-1070, 1024, 5)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    assert all(r.b == bits_of(r.v) for r in got)


def value_at(values, q):
    v = sorted(values)
    return v[max(0, int(q * len(v)) - 1)]


@pytest.mark.parametrize("q", [0.95, 0.5, 0.0, 1.0])
def test_pick_equals_the_sort(spark, q):
    rnd = random.Random(int(q * 100))
    groups = {"bits": random_doubles(rnd, 500), "special": SPECIAL * 3, "one": [4.25], "ties": [7.0] * 300 + [8.0] * 20,
              "near": [1000 + rnd.random() * 1e-9 for _ in range(400)], "neg": [-rnd.expovariate(1) for _ in range(333)],
              "hot": [rnd.gauss(0, 1) for _ in range(3000)], None: [2.0, 3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("nothing", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.p for r in floor_rank_pick(df, "v", ["g"], q, alias="p").collect()}
    assert got == {g: value_at(vs, q) for g, vs in groups.items()}
    whole = [v for vs in groups.values() for v in vs]
    assert floor_rank_pick(df, "v", (), q, alias="p").first().p == value_at(whole, q)


def test_summary(spark):
    rnd = random.Random(9)
    groups = {"a": [rnd.uniform(0, 3000) for _ in range(777)], None: [1.5, 2.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r for r in summary_with_floor_rank(df, "v", ["g"]).collect()}
    for g, vs in groups.items():
        r = got[g]
        assert (r.n, r.min, r.max, r.pick) == (len(vs), min(vs), max(vs), value_at(vs, 0.95))
        assert abs(r["mean"] - math.fsum(vs) / len(vs)) < 1e-9
    none = summary_with_floor_rank(df.where("v < 0"), "v").first()
    assert none.n is None or none.n == 0


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    picks = [floor_rank_pick(df, "v", (), q, alias="p").first().p for q in (0.4, 0.7, 1.0)]
    assert picks[:2] == [1.0, float("inf")] and math.isnan(picks[2])
    assert floor_rank_pick(df.unionByName(df.where("v = 1")), "v", (), 0.8, alias="p").first().p == float("inf")


def test_values_are_not_sorted_or_moved(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        floor_rank_pick(df, "v", ["g"]).explain("formatted")
    text = buf.getvalue()
    assert "rangepartitioning" not in text and "ExistingRDD" not in text
    assert text.count("partial_count") >= 3                          # each histogram is counted within the tasks first
