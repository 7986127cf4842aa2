"""Streaming consumers built from the same operators as the batch queries.

* analytics: messages -> decode -> window statistics and instant alerts;
* storage: messages -> decode -> constraint check -> readings table, with
  rejected messages beside it.

Each consumer is its own ``StreamingQuery`` with its own checkpoint (the
checkpoint plays the consumer group), so two consumers read one topic
independently and both resume from their checkpoint after a failure.

Window statistics come in two forms.  ``run_windows`` folds micro-batches into
a table of open windows and closes each window once, behind the frontier of
committed micro-batches (``window_store``).  ``window_stats_stream`` keeps the
state in Spark with a watermark; rows later than the stated delay are dropped
there and counted in the query's progress.  ``with_heartbeat`` lets both close
windows when the flow stops.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldpulse.operators import alerts as AL
from fieldpulse.operators import windows as W
from fieldpulse.schema import INSTANT_ALERT_THRESHOLD, READING_COLUMNS, STORAGE_BATCH_SIZE
from fieldpulse.session import remove_path
from fieldpulse.sources import messages as M
from fieldpulse.streaming import compaction
from fieldpulse.streaming.buffer import BufferedTable
from fieldpulse.streaming.window_store import WindowStore

TRIGGER = "5 seconds"


def kafka_messages(spark: SparkSession, bootstrap_servers: str, topic: str,
                   starting_offsets: str = "earliest", max_offsets_per_trigger: int | None = None,
                   min_partitions: int | None = None
                   ) -> DataFrame:  # pragma: no cover - needs the Kafka connector and a broker
    """Topic scan: value as text, arrival = the time of the micro-batch.

    The record's own timestamp is the producer's by default and may lie
    anywhere; it is kept as ``sent_ts``.

    ``max_offsets_per_trigger`` sizes (and paces) micro-batches;
    ``min_partitions`` splits the offset range of a topic partition into
    several tasks without a shuffle (a topic with one partition would
    otherwise decode on one core).
    """
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    if min_partitions:
        r = r.option("minPartitions", str(min_partitions))
    return r.load().select(F.col("value").cast("string").alias("value"), F.current_timestamp().alias("arrival_ts"),
                           F.col("timestamp").alias("sent_ts"), "partition", "offset")


def file_messages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Messages as lines of text files landing in a folder; arrival = ingest time."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path).withColumn("arrival_ts", F.current_timestamp())


def with_event_clock(readings: DataFrame, delay: str, time_col: str = "arrival_ts") -> DataFrame:
    """The time as a zoned timestamp with a watermark, so that ``append`` closes windows."""
    timed = readings.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    # a condition on the temperature must not move below the watermark: rows without one (heartbeats) still tell the time
    dated = F.col(time_col) >= F.lit("0001-01-01").cast("timestamp")
    return timed.withColumn("temperature", F.when(dated, F.col("temperature")))


def window_stats_stream(readings: DataFrame, size: str, threshold: float, delay: str,
                        time_col: str = "arrival_ts", start: str | None = None) -> DataFrame:
    """Windowed statistics in ``append`` mode with the state in Spark.

    A window is emitted once the watermark (the newest time less ``delay``)
    passed its end; rows later than that are dropped as late data and counted
    as ``numRowsDroppedByWatermark`` in the query's progress.  ``start`` shifts
    the window grid (windows are epoch-aligned by default).
    """
    stats = W.window_global_stats(with_event_clock(readings, delay, time_col), size, threshold, time_col=time_col,
                                  start=start)
    return stats.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
                .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def _started(writer, available_now: bool, trigger: str = TRIGGER) -> StreamingQuery:
    """Start a writer; with ``available_now`` wait until everything available is processed."""
    q = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()
    if available_now:
        q.awaitTermination()
    return q


def with_heartbeat(readings: DataFrame, time_col: str = "arrival_ts", per_second: int = 1) -> DataFrame:
    """A stream of readings united with rows that hold the time of their micro-batch and nothing else.

    They keep the clock of an idle source running: a trigger always has a
    micro-batch, and its time is seen by a frontier or a watermark.  Windows
    leave them out, as they have no temperature.
    """
    beats = (readings.sparkSession.readStream.format("rate").option("rowsPerSecond", str(per_second))
             .option("numPartitions", "1").load())
    kinds = {f.name: f.dataType for f in readings.schema.fields}
    now = F.current_timestamp().cast(kinds[time_col]).alias(time_col)
    return readings.unionByName(beats.select(*[now if n == time_col else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]))


def run_windows(readings: DataFrame, store: WindowStore, checkpoint: str, available_now: bool = True,
                trigger: str = TRIGGER) -> StreamingQuery:
    """Fold micro-batches into the windows of ``store``; windows and their alerts are written as they close."""
    return _started(readings.writeStream.foreachBatch(store.write).option("checkpointLocation", checkpoint), available_now,
                    trigger)


def run_to_parquet(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                   available_now: bool = True, partition_cols: list[str] | None = None,
                   trigger: str = TRIGGER) -> StreamingQuery:
    """Start a query into a parquet folder (exactly-once file sink) and, with
    ``available_now``, wait until everything available is processed."""
    w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    return _started(w.option("path", out_path), available_now, trigger)


def jdbc_rows(url: str, table: str, properties: dict[str, str], batch_size: int = STORAGE_BATCH_SIZE):
    """Writer of accepted readings into a relational table (multi-row inserts of ``batch_size``).

    At least once: a micro-batch that is run again inserts its rows again.
    Not exercised here: it needs a database server.
    """
    def write(rows: DataFrame) -> None:  # pragma: no cover
        (rows.select(*READING_COLUMNS).write.mode("append").option("batchsize", str(batch_size))
         .jdbc(url, table, properties=properties))
    return write


def _observed(seen: Observation) -> dict[str, int]:
    """The counts that a write has observed; zeros if the optimizer left the rows out because there surely are none."""
    try:
        got = seen.get
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        got = {}
    return {k: int(got.get(k) or 0) for k in ("received", "stored", "errors")}


def storage_batches(path: str, also=None, buffer: BufferedTable | None = None):
    """``foreachBatch`` writer of decoded and checked messages.

    One write: ``<path>/rows/is_valid=true`` is the readings table, with the
    time of the micro-batch as ``received_at``, and ``is_valid=false`` holds the
    rejected messages with their reasons.  A micro-batch that is run again
    replaces its own partitions.  Its counts are observed by that write (nothing
    is read back) and kept in ``<path>/counts``.  ``also`` gets the accepted
    rows.  With a ``buffer`` the accepted rows go to its table in full batches,
    and leave ``rows`` once they are there.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        view = batch if "is_valid" in batch.columns else M.storage_view(M.decode(batch))
        spark = batch.sparkSession
        seen = Observation()
        out = f"{path}/rows"
        (view.select(*READING_COLUMNS, F.current_timestamp().cast("timestamp_ntz").alias("received_at"),
                     F.when(~F.col("is_valid"), F.col("value")).alias("value"), "reject_reason",
                     "is_valid", F.lit(batch_id).cast("long").alias("batch_id"))
         .observe(seen, F.count(F.lit(1)).alias("received"), F.count_if("is_valid").alias("stored"),
                  F.count_if(~F.col("is_valid")).alias("errors"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("is_valid", "batch_id").parquet(out))
        n = _observed(seen)
        (spark.createDataFrame([tuple(n.values())], "received long, stored long, errors long")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}"))
        accepted = f"{out}/is_valid=true/batch_id={batch_id}"                # this micro-batch's own folder
        rows = spark.read.parquet(accepted) if n["stored"] else None
        if also is not None and rows is not None:
            also(rows)
        if buffer is not None:
            buffer.accept(None if rows is None else rows.select(*READING_COLUMNS, "received_at", "_metadata"), batch_id,
                          n["received"], n["stored"], n["errors"])
            remove_path(spark, accepted)
    return write


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return compaction.table(spark, path, "rows")


def stored_readings(spark: SparkSession, path: str) -> DataFrame:
    """The readings table: the reading columns and ``received_at``."""
    return _rows(spark, path).where("is_valid").select(*READING_COLUMNS, "received_at")


def rejected_messages(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).where("NOT is_valid").select("value", "reject_reason", "received_at")


def storage_counts(spark: SparkSession, path: str) -> DataFrame:
    """received, stored and errors over all micro-batches (one row)."""
    c = compaction.table(spark, path, "counts")
    return c.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in ("received", "stored", "errors")])


def run_storage(messages: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                decode_parallelism: int | None = None, also=None, buffer: BufferedTable | None = None) -> StreamingQuery:
    """Storage consumer: decode, check, write accepted and rejected rows and their counts.

    With a ``buffer`` accepted rows are inserted in full batches and the rest
    waits for the next micro-batch or a drain; without, each is stored at once.

    ``decode_parallelism`` spreads each micro-batch over that many tasks
    before decoding, for sources with fewer partitions than cores; leave it
    unset when the source is already wide (for Kafka prefer the source's
    ``min_partitions``, which splits without a shuffle).
    """
    if decode_parallelism:
        messages = messages.repartition(int(decode_parallelism))
    view = M.storage_view(M.decode(messages))
    return _started(view.writeStream.foreachBatch(storage_batches(path, also, buffer))
                    .option("checkpointLocation", checkpoint), available_now)


def analytics_view(messages: DataFrame) -> DataFrame:
    """Usable readings of the analytics consumer (only the fields it needs are parsed)."""
    return M.analytics_view(M.decode(messages, fields=M.ANALYTICS_FIELDS)).where("temperature_ok").select(
        "arrival_ts", F.col("a_device_id").alias("device_id"), F.col("a_temperature").alias("temperature"),
        F.col("a_published_at").alias("published_at"))


def instant_alert_stream(view: DataFrame, alert_at=None, instant: bool = False,
                         threshold: float = INSTANT_ALERT_THRESHOLD) -> DataFrame:
    """Alert records per message: stateless, so they never wait for a window."""
    at = F.current_timestamp().cast("timestamp_ntz") if alert_at is None else alert_at
    return AL.alert_records_instant(AL.instant_alerts(view, instant, threshold if instant else None, alert_at=at))
