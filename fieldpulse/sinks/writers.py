"""Writers for the pipeline's outputs (batch side; streaming in fieldpulse.streaming)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.schema import READING_COLUMNS


def uuid_of(value: Column) -> Column:
    """A UUID text made from a value's MD5."""
    h = F.md5(value.cast("string"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def publish_json(readings: DataFrame, columns: Sequence[str] = READING_COLUMNS, key: str | None = None) -> DataFrame:
    """(key, value) messages: a random UUID (or one made from a column, which is
    the same on every retry) and the reading as a JSON object; null fields are
    left out of the object."""
    present = [c for c in columns if c in readings.columns]
    k = F.uuid() if key is None else uuid_of(F.col(key))
    return readings.select(k.alias("key"), F.to_json(F.struct(*present)).alias("value"))


def kafka_options(bootstrap_servers: str, topic: str, retry_backoff_ms: int = 3000) -> dict[str, str]:
    """Producer options: wait for all in-sync replicas, retry every 3 s (fixed value)."""
    return {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic, "kafka.acks": "all",
            "kafka.retry.backoff.ms": str(retry_backoff_ms)}


def write_kafka(messages: DataFrame, bootstrap_servers: str, topic: str) -> None:  # pragma: no cover - needs a broker
    messages.write.format("kafka").options(**kafka_options(bootstrap_servers, topic)).save()


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a table folder (the readings table)."""
    df.write.mode("append").format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Per-container resource report, one JSON object per container line."""
    report.write.mode("overwrite").json(path)


def append_summary(rows: DataFrame, path: str) -> None:
    """Append run rows to a summary CSV folder (every file has a header; no row is dropped)."""
    rows.write.mode("append").option("header", True).csv(path)


def result_pairs(runs: DataFrame, id_cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``key: value`` result lines as a long table (run id, key, value text)."""
    wide = runs.select(*id_cols, *[F.col(k).cast("string").alias(k) for k in keys])
    return wide.unpivot(list(id_cols), list(keys), "key", "value")
