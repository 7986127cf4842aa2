"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "fieldpulse",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session tuned for the engine: AQE with skew handling, UTC, no UI."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # streaming window state off the JVM heap, snapshotted with the checkpoint
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         # checkpoints written to cut lineage are deleted once nothing refers to them
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions or master.startswith("local"):       # a cluster keeps its own setting
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def cluster_settings(input_bytes: int, partition_bytes: int = 256 << 20, max_file_split: int = 512 << 20
                     ) -> dict[str, str]:
    """Settings sized to the input, for a session on a cluster.

    The initial shuffle partition count gives about ``partition_bytes`` of
    input per task (AQE then merges small ones and splits skewed ones), and
    file splits stay large enough to keep the task count manageable.  At
    100 TB with 256 MiB this is about 400,000 initial partitions.
    """
    shuffle = max(200, -(-int(input_bytes) // int(partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(max_file_split),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; applied before each query.

    The checkpoint directory is read from the session.  Only when the
    cluster names none (local runs, tests) a private one is created.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get(_CHECKPOINT_KEY, "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        try:
            configured = spark.conf.get(_CHECKPOINT_KEY)
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fieldpulse-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: tasks to spread a narrow batch input over before CPU-heavy work; unset: none, and no shuffle
DECODE_TASKS_KEY = "fieldpulse.decode.tasks"


def spread(df, *keys: str):
    """Spread a batch input over ``fieldpulse.decode.tasks`` tasks, if the session sets it.

    A table stored as one row group scans as one task, and every per-message
    JSON encode/decode then runs on one core.  A wide table needs no setting
    (and gets no shuffle).  The hash keys keep the rows' places the same on a
    retry.
    """
    tasks = df.sparkSession.conf.get(DECODE_TASKS_KEY, None)
    return df if df.isStreaming or not tasks else df.repartition(int(tasks), *keys)


def local_path(path: str) -> str:
    """A ``file:`` URI as a plain path, for driver-side file calls (local runs only)."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark can write to; False if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
