"""Adapters from the generated ``events`` table to the pipeline's shapes.

``events`` (event_id, ts, user_id, event_type, value, props) plays the sensor
stream.  All adapters are column expressions, so filters and column pruning
still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.functions.timefmt import add_millis
from fieldpulse.session import spread

# Fixed adapter rules (see FIXTURES.md §2).
BAD_EVERY = 97                      # a message is malformed when event_id % 97 = 0
ALERT_DELAY_MOD_MS = 3000           # alert_at = ts + (event_id % 3000) ms
OFFSET_PARTITIONS = 4               # topic partition = user_id % 4
OFFSET_COMMIT_BEFORE = "2024-01-20 00:00:00"   # committed offset = rows before this instant
OFFSET_UNCOMMITTED_PARTITION = 3    # this partition has no committed offset
SNAPSHOT_BEFORE = "2024-01-10 00:00:00"
SNAPSHOT_AFTER = "2024-01-20 00:00:00"
MEM_SUFFIXES = ("GiB", "MiB", "KiB", "B")      # chosen by event_id % 4
SAMPLE_SERVICES = ("click", "view", "error")   # services kept by the container filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def readings(ev: DataFrame) -> DataFrame:
    """Reading shape: arrival = ts, device = user, crop type = event type."""
    return ev.select(
        "event_id",
        F.col("ts").alias("arrival_ts"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("device_id"),
        F.col("event_type").alias("crop_type"),
        F.col("value").alias("temperature"),
    )


def published_text(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def timed_readings(ev: DataFrame) -> DataFrame:
    """Readings with publication text and the instant an alert would be raised."""
    return readings(ev).select(
        "*",
        published_text(F.col("arrival_ts")).alias("published_at"),
        add_millis(F.col("arrival_ts"), F.col("event_id") % F.lit(ALERT_DELAY_MOD_MS)).alias("alert_at"),
    )


def is_bad_message(ev_id) -> F.Column:
    return (ev_id % F.lit(BAD_EVERY)) == 0


def messages(ev: DataFrame) -> DataFrame:
    """Wire messages (event_id, arrival_ts, run, value) as JSON text.

    A reading becomes a JSON object; every 97th message is corrupted on the
    wire (its text is cut inside the object), so parsers must set it aside.
    """
    r = timed_readings(spread(ev, "event_id"))
    body = F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("device_id"),
        F.col("crop_type"),
        F.col("temperature"),
        F.col("published_at"),
    ))
    value = F.when(is_bad_message(F.col("event_id")),
                   F.concat(F.lit('{"device_id": "'), F.col("device_id"), F.lit('", temp'))).otherwise(body)
    return r.select("event_id", "arrival_ts", F.col("crop_type").alias("run"), value.alias("value"))


# Texts of the mixed messages, chosen by event_id % 16 (kinds 12 to 15 are whole messages).
def mixed_messages(ev: DataFrame) -> DataFrame:
    """(event_id, arrival_ts, value): messages of every accepted and rejected kind."""
    eid = F.col("event_id")
    whole = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("user_id").cast("string").alias("device_id"), F.col("value").alias("temperature")))
    rest = F.substring(whole, 2, 1_000_000)
    kinds = [
        F.concat(F.lit('{"device_id": "'), F.col("user_id").cast("string"), F.lit('", temp')),   # cut
        F.concat(whole, F.lit(" garbage")),
        F.concat(whole, F.lit('{"a":1}')),
        F.lit("5} x"),
        F.lit('1,"w":2'),
        F.lit("7"),
        F.lit("[1,2]"),
        F.concat(F.lit('{"location":"'), F.lit("y" * 101), F.lit('",'), rest),
        F.lit('{"timestamp":"2024-01-01 00:00:00","temperature":1.5}'),
        F.lit('{"timestamp":"2024-01-01 00:00:00","device_id":"d","temperature":"warm"}'),
        F.concat(F.lit('{"irrigation_needed":1.0,'), rest),
        F.concat(F.lit('{"irrigation_needed":1.5,'), rest),
    ]
    value = whole
    for k, text in enumerate(kinds):
        value = F.when(eid % 16 == k, text).otherwise(value)
    return ev.select("event_id", F.col("ts").alias("arrival_ts"), value.alias("value"))


def counter_documents(ev: DataFrame) -> DataFrame:
    """Counter documents: ``props`` is a JSON object with integer field ``k``."""
    return ev.select("event_id", F.col("ts").alias("arrival_ts"), F.col("props").alias("value"))


def container_samples(ev: DataFrame) -> DataFrame:
    """Container resource samples in the text form the stats sampler writes."""
    eid = F.col("event_id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in MEM_SUFFIXES]), (eid % 4 + 1).cast("int"))
    return ev.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("run-"), F.col("event_type"), F.lit("-1")).alias("container"),
        F.concat((eid % 900).cast("string"), F.lit("%")).alias("cpu_percent"),
        F.concat((eid % 2000).cast("string"), suffix).alias("mem_used"),
        F.concat((eid % 500).cast("string"), F.lit("kB / "), (eid % 70).cast("string"), F.lit("MB")).alias("net_io"),
    )


def partition_offsets(ev: DataFrame) -> DataFrame:
    """Consumer-group offsets per topic partition (one group, one topic)."""
    part = (F.col("user_id") % OFFSET_PARTITIONS).cast("int")
    before = F.col("ts") < F.lit(OFFSET_COMMIT_BEFORE).cast("timestamp_ntz")
    g = (ev.groupBy(part.alias("partition"))
         .agg(F.count(F.lit(1)).alias("log_end_offset"),
              F.count_if(before).alias("committed")))
    current = F.when(F.col("partition") != OFFSET_UNCOMMITTED_PARTITION, F.col("committed"))
    return g.select(
        F.lit("field-storage").alias("group"),
        F.lit("field-readings").alias("topic"),
        "partition",
        current.alias("current_offset"),
        "log_end_offset",
        (F.col("log_end_offset") - current).alias("lag"),
    )


def hourly_samples(ev: DataFrame) -> DataFrame:
    """One sample per run and hour: the number of messages seen in that hour."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return (ev.groupBy(F.col("event_type").alias("run"), hour.alias("sample_ts"))
            .agg(F.count(F.lit(1)).alias("value"),
                 F.count_if(~is_bad_message(F.col("event_id"))).alias("stored")))
