import random

from pyspark.sql import functions as F

from fieldpulse.operators import latency as L
from fieldpulse.operators.ordinal import with_global_ordinal
from fieldpulse.operators.radix import floor_rank_pick

MQTT = [1970.49, 1709.32, 1594.60, 2055.20, 1536.33, 2040.85, 1360.95, 1880.63, 1254.68, 1628.93]
KAFKA = [2615.61, 2544.29, 2547.64, 2424.07, 2455.30, 2427.36, 2301.07, 2251.64, 2148.81, 2953.09]


def test_golden_published_latencies(spark):
    df = spark.createDataFrame([("mqtt", v) for v in MQTT] + [("kafka", v) for v in KAFKA], "run string, latency_ms double")
    got = {r.run: r for r in L.latency_summary(df, "latency_ms", ["run"]).collect()}
    assert got["mqtt"].summary.split(",")[0] == "1703.20" and got["mqtt"].p95_ms == 2040.85
    assert got["kafka"].summary.split(",")[0] == "2466.89" and got["kafka"].p95_ms == 2615.61


def test_summary_edges(spark):
    one = spark.createDataFrame([(5.5,)], "latency_ms double")
    r = L.latency_summary(one).first()
    assert (r.n, r.avg_ms, r.min_ms, r.max_ms, r.p95_ms) == (1, 5.5, 5.5, 5.5, 5.5)
    empty = L.latency_summary(one.where("1 = 0")).first()
    assert empty.summary == "0.00,0.00,0.00,0.00"


def _brute_p95(vals):
    vals = sorted(vals)
    return vals[max(0, int(0.95 * len(vals)) - 1)]


def test_floor_rank_skewed_groups_vs_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 17}"        # one group holds a third of all rows
        rows.append((g, float(rnd.randint(0, 500))))        # many ties
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.p95 for r in floor_rank_pick(df, "v", ["g"], 0.95, alias="p95").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert got == {g: _brute_p95(v) for g, v in groups.items()}


def test_global_ordinal_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k long").repartition(5)
    o = with_global_ordinal(df, ["k", "id"], name="rn", num_partitions=7)
    got = {r.id: r.rn for r in o.collect()}
    expect = {id_: pos + 1 for pos, (id_, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == expect
    g = with_global_ordinal(df, ["id"], ["k"], name="rn", with_total=True)
    for r in g.collect():
        assert 1 <= r.rn <= r.rn_total
    assert g.groupBy("k").agg(F.max("rn").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


def test_ordinal_under_aqe_coalescing(spark):
    # many tiny range partitions that AQE merges into a few uneven ones
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2kb",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rnd = random.Random(5)
        rows = [(i, rnd.randint(0, 9), float(rnd.randint(0, 300))) for i in range(5000)]
        df = spark.createDataFrame(rows, "id long, g long, v double").repartition(7)
        o = with_global_ordinal(df, ["v", "id"], ["g"], name="rn")
        got = {r.id: r.rn for r in o.collect()}
        expect = {}
        for g in range(10):
            members = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
            expect.update({r[0]: i + 1 for i, r in enumerate(members)})
        assert got == expect
        p = {r.g: r.p95 for r in floor_rank_pick(df, "v", ["g"], alias="p95").collect()}
        assert p == {g: _brute_p95([r[2] for r in rows if r[1] == g]) for g in range(10)}
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_latency_match(spark):
    rows = [("r", 1, "p1", True, 5.0), ("r", 2, "p2", True, 10.0), ("r", 3, "p3", False, None),
            ("s", 1, "q1", True, 7.0), ("s", 2, "q2", True, 8.0), ("t", 1, "z1", False, None)]
    v = spark.createDataFrame(rows, "run string, o int, published_at string, is_alert boolean, e2e_latency_ms double")
    got = {r.run: (r.matched, r.alert_published_at, r.accepted_latency_ms)
           for r in L.latency_match(v, "is_alert", ["run"], ["o"]).collect()}
    assert got == {"r": (False, "p2", None), "s": (True, "q2", 8.0), "t": (False, None, None)}


def test_many_ties_meet_before_the_shuffle(spark):
    # nine tenths of the values are equal: they are one row of the histogram
    rows = [(i % 3, 0.0 if i % 10 else float(i)) for i in range(30000)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(8)
    got = {r.g: r.p95 for r in floor_rank_pick(df, "v", ["g"], alias="p95").collect()}
    assert got == {g: _brute_p95([v for k, v in rows if k == g]) for g in range(3)}
    # the order keys of a sort are total, so equal values are spread as well
    o = with_global_ordinal(spark.range(20000).selectExpr("id", "0.0D AS v").repartition(8), ["v", "id"], name="rn",
                            num_partitions=16)
    sizes = [r["count"] for r in o.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 20000 / 16 and o.where("rn = id + 1").count() == 20000


def test_summary_mean_is_not_cut(spark):
    df = spark.createDataFrame([(1e15,), (1e-7,), (0.00004,)], "latency_ms double")
    s = L.latency_summary(df).first()
    assert s.n == 3 and s.max_ms == 1e15 and s.avg_ms == round((1e15 + 1e-7 + 0.00004) / 3, 2)
