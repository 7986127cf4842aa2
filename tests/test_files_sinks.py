import json
import os

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import resources as RS
from fieldpulse.sinks import writers as K
from fieldpulse.sources import files as FS


def test_csv_by_name(spark, scratch):
    p = os.path.join(scratch, "r.csv")
    with open(p, "w") as f:
        f.write("temperature,extra,device_id,timestamp\n24.5,zz,d1,2024-01-01 00:00:00\n")
    r = FS.read_readings_csv(spark, p).first()
    assert r.device_id == "d1" and r.temperature == 24.5 and r.location is None
    assert str(r.timestamp) == "2024-01-01 00:00:00"


def test_csv_bad_value_fails(spark, scratch):
    p = os.path.join(scratch, "bad.csv")
    with open(p, "w") as f:
        f.write("timestamp,device_id,temperature\n2024-01-01 00:00:00,d1,abc\n")
    with pytest.raises(Exception):
        FS.read_readings_csv(spark, p).collect()


def test_latency_file(spark, scratch):
    p = os.path.join(scratch, "lat.txt")
    with open(p, "w") as f:
        f.write("1.5\n\n  2.5 \n")
    assert sorted(r[0] for r in FS.read_latencies(spark, p).collect()) == [1.5, 2.5]
    assert FS.read_latencies(spark, os.path.join(scratch, "missing.txt")).count() == 0


def test_stats_samples_and_report(spark, scratch):
    p = os.path.join(scratch, "stats.csv")
    with open(p, "w") as f:
        f.write("timestamp,name,cpu_percent,mem_used,net_io\n"
                "t,proj-analytics-1,10%,1GiB / 2GiB,1GB / 1MB\n"
                "t,proj-analytics-1,20%,512KiB / 1GiB,0B / 0B\n"
                "t,proj-other-1,99%,1MiB / 1GiB,1kB / 1kB\n"
                "t,,5%,1MiB / 1GiB,1kB / 1kB\n")
    s = FS.read_stats_samples(spark, p)
    rep = RS.resource_by_container(s)
    rows = rep.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.container == "proj-analytics-1" and r.avg_cpu == 15.0 and r.peak_cpu == 20.0
    assert r.peak_ram_mb == 1024.0 and r.avg_net_mb == 512.5
    pair = RS.pair_format(rep, "cpu").first()
    assert pair.cpu_pair == "15.0/20.0"
    look = RS.report_field_lookup(rep, spark.createDataFrame([("proj-analytics-1",), ("nope",)], "container string"),
                                  "peak_cpu")
    assert {r.container: r.peak_cpu for r in look.collect()} == {"proj-analytics-1": "20.0", "nope": "N/A"}
    obj = json.loads(RS.report_object(rep).first().report)
    assert obj["proj-analytics-1"]["peak_cpu"] == 20.0


def test_publish_and_pairs(spark):
    df = spark.createDataFrame([("d1", 23.16, None)], "device_id string, temperature double, location string")
    m = K.publish_json(df, ["device_id", "temperature", "location"]).first()
    assert json.loads(m.value) == {"device_id": "d1", "temperature": 23.16}   # nulls left out
    assert len(m.key) == 36
    runs = spark.createDataFrame([("A", 10, "0.00")], "run string, sent long, lost string")
    pairs = [(r.key, r.value) for r in K.result_pairs(runs, ["run"], ["sent", "lost"]).collect()]
    assert sorted(pairs) == [("lost", "0.00"), ("sent", "10")]
    one = K.publish_json(df, ["device_id"], key="device_id")
    assert one.first().key == one.first().key and len(one.first().key) == 36      # the same on every retry


def test_summary_append_keeps_every_row(spark, scratch):
    p = os.path.join(scratch, "summary")
    a = spark.createDataFrame([("A", 1)], "scenario string, n long")
    K.append_summary(a, p)
    K.append_summary(a.withColumn("n", F.lit(2)), p)
    back = spark.read.option("header", True).csv(p)
    assert sorted(int(r.n) for r in back.collect()) == [1, 2]


def test_append_keeps_replayed_rows(spark, scratch):
    # no de-duplication: a replayed message is stored again (the key is not unique)
    p = os.path.join(scratch, "table")
    rows = spark.createDataFrame([("d1", 1.0), ("d2", 2.0)], "device_id string, temperature double")
    K.append_table(rows, p)
    K.append_table(rows.limit(1), p)
    assert spark.read.parquet(p).count() == 3


def test_csv_files_of_different_headers_are_refused(spark, scratch):
    p = os.path.join(scratch, "two")
    os.makedirs(p)
    with open(os.path.join(p, "a.csv"), "w") as f:
        f.write("timestamp,device_id,location\n2024-01-01 00:00:00,dev1,loc1\n")
    with open(os.path.join(p, "b.csv"), "w") as f:
        f.write("timestamp,location,device_id\n2024-01-01 00:00:00,loc2,dev2\n")
    with pytest.raises(Exception):
        FS.read_readings_csv(spark, p).collect()
    each = [FS.read_readings_csv(spark, os.path.join(p, n)) for n in ("a.csv", "b.csv")]
    rows = each[0].unionByName(each[1]).collect()
    assert sorted((r.device_id, r.location) for r in rows) == [("dev1", "loc1"), ("dev2", "loc2")]


def test_samples_have_defaults_and_the_name_fallback(spark, scratch):
    p = os.path.join(scratch, "s.csv")
    with open(p, "w") as f:
        f.write("timestamp,name,cpu_percent,mem_used\nt, x-kafka-1 ,,\n")
    r = FS.read_stats_samples(spark, p).first()
    assert tuple(r) == ("t", "x-kafka-1", "0", "0", "0 / 0")
