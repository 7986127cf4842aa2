import json
import os

from pyspark.sql import functions as F

from fieldpulse import cli
from fieldpulse.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_latency_and_group_lag(spark, scratch, capsys):
    lat = os.path.join(scratch, "lat.txt")
    with open(lat, "w") as f:
        f.write("\n".join(["1970.49", "1709.32", "1594.60", "2055.20", "1536.33", "2040.85", "1360.95",
                           "1880.63", "1254.68", "1628.93", ""]))
    assert cli.main(["latency", lat], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "1703.20,1254.68,2055.20,2040.85"
    assert cli.main(["latency", os.path.join(scratch, "missing")], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "0.00,0.00,0.00,0.00"
    listing = os.path.join(scratch, "listing.txt")
    with open(listing, "w") as f:
        f.write("GROUP TOPIC PARTITION CURRENT-OFFSET LOG-END-OFFSET LAG CONSUMER-ID HOST CLIENT-ID\n"
                "g t 0 5 9 4 - - -\n")
    assert cli.main(["group-lag", listing], spark=spark) == 0
    assert capsys.readouterr().out.strip() == "5\t9\t4"


def test_resources(spark, scratch):
    stats = os.path.join(scratch, "stats.csv")
    with open(stats, "w") as f:
        f.write("timestamp,container,cpu_percent,mem_used,net_io\nt,x-analytics-1,10%,1GiB / 2GiB,1MB / 1MB\n")
    out = os.path.join(scratch, "report")
    assert cli.main(["resources", stats, out, "--single-object"], spark=spark) == 0
    text = spark.read.text(out).first().value
    assert json.loads(text)["x-analytics-1"]["peak_ram_mb"] == 1024.0


def test_replay_storage_analytics(spark, scratch, capsys):
    ev = A.events(spark, SF)
    csv = os.path.join(scratch, "readings.csv")
    A.readings(ev).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                          "device_id", "crop_type", "temperature").coalesce(1) \
        .write.option("header", True).csv(csv)
    msgs = os.path.join(scratch, "msgs")
    assert cli.main(["replay", csv, msgs, "--batch-size", "100"], spark=spark) == 0
    sent = spark.read.parquet(msgs)
    assert sent.count() == ev.count() and sent.agg(F.max("batch_no")).first()[0] == -(-ev.count() // 100)
    lines = os.path.join(scratch, "lines")
    sent.select("value").write.text(lines)
    msgs = lines
    table = os.path.join(scratch, "table")
    assert cli.main(["storage", msgs, table, "--checkpoint", os.path.join(scratch, "ck")], spark=spark) == 0
    assert capsys.readouterr().out.strip() == f"received={ev.count()} stored={ev.count()} errors=0"
    out = os.path.join(scratch, "analytics")
    assert cli.main(["analytics", msgs, out, "--instant", "--checkpoint", os.path.join(scratch, "ck2")],
                    spark=spark) == 0
    assert spark.read.parquet(os.path.join(out, "instant_alerts")).count() == ev.where("value > 40").count()
    stats = spark.read.parquet(os.path.join(out, "windows", "stats"))
    assert stats.agg(F.sum("count")).first()[0] == ev.count()          # the last window is emitted too
    alerts = spark.read.parquet(os.path.join(out, "windows", "alerts")).count()
    assert alerts == stats.where("avg_temperature > 50").count()


def test_stats_document(spark, scratch, capsys):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a", 40.0), ("2024-01-01 00:00:12", "a", 61.0),
                                  ("2024-01-01 00:00:13", "b", 52.5)], "timestamp string, device_id string, temperature double")
    p = os.path.join(scratch, "readings")
    rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "device_id", "temperature").write.parquet(p)
    assert cli.main(["stats", p], spark=spark) == 0
    doc = json.loads(capsys.readouterr().out.strip())
    assert doc["count"] == 2 and doc["alert_triggered"] and set(doc["per_device"]) == {"a", "b"}
    assert doc["avg_temperature"] == 56.75


def test_rules_over_samples(spark, scratch, capsys):
    path = os.path.join(scratch, "samples.csv")
    series = {"a": [9, 9, 7, 3, 3, 3, 3], "b": [8, 1, 2, 9, 4, 5, 1]}
    with open(path, "w") as f:
        f.write("value,run,sample_ts\n")
        f.writelines(f"{v},{r},2024-01-01 00:00:{i:02d}\n" for r, vs in series.items() for i, v in enumerate(vs))

    def said(*args):
        assert cli.main([args[0], path, *args[1:]], spark=spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]

    assert [d.get("drained_index") for d in said("drained")] == [6, None]
    assert [d["timed_out"] for d in said("drained", "--timeout", "6")] == [True, True]
    assert [d["recovery_s"] for d in said("recovery", "--needed", "3", "--horizon", "60")] == ["6", "7"]
    assert [d["peak_backlog"] for d in said("peak-backlog")] == [9, 9]
