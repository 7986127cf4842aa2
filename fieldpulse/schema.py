"""Schemas, limits and fixed configuration values of the sensor pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original pipeline's configuration.
# Thresholds: window alert 50, instant (benchmark) alert 40; window 10 s.
# Storage batch sizes: 500 (benchmark runs); ingestion replay: 20 rows every 5 s.
# Benchmark container services (substring "-<service>-" of a container name):
#   mosquitto, emqtt-bench, kafka, data-storage, analytics, postgres
# Column length limits of the readings table:
#   device_id 50, location 100, crop_type 50, season 20, crop_health 50, pest_risk 20
# ---------------------------------------------------------------------------
WINDOW_ALERT_THRESHOLD = 50.0
INSTANT_ALERT_THRESHOLD = 40.0
WINDOW_SECONDS = 10
STORAGE_BATCH_SIZE = 500
REPLAY_BATCH_SIZE = 20
REPLAY_INTERVAL_S = 5
PROGRESS_EVERY = 1000
BENCHMARK_SERVICES = (
    "mosquitto",
    "emqtt-bench",
    "kafka",
    "data-storage",
    "analytics",
    "postgres",
)
LENGTH_LIMITS = {
    "device_id": 50,
    "location": 100,
    "crop_type": 50,
    "season": 20,
    "crop_health": 50,
    "pest_risk": 20,
}
NOT_NULL_COLUMNS = ("timestamp", "device_id")

# The 17 reading fields in table order with their types.
READING_FIELDS: list[tuple[str, T.DataType]] = [
    ("timestamp", T.TimestampNTZType()),
    ("device_id", T.StringType()),
    ("location", T.StringType()),
    ("crop_type", T.StringType()),
    ("season", T.StringType()),
    ("temperature", T.DoubleType()),
    ("humidity", T.DoubleType()),
    ("rainfall", T.DoubleType()),
    ("soil_moisture", T.DoubleType()),
    ("soil_ph", T.DoubleType()),
    ("light_intensity", T.DoubleType()),
    ("fertilizer_used", T.DoubleType()),
    ("irrigation_needed", T.IntegerType()),
    ("crop_health", T.StringType()),
    ("yield_estimate", T.DoubleType()),
    ("pest_risk", T.StringType()),
    ("anomaly_flag", T.IntegerType()),
]
READING_COLUMNS = [n for n, _ in READING_FIELDS]
READING = T.StructType([T.StructField(n, t, True) for n, t in READING_FIELDS])

# Fields of a message; every one is read as text so that quoted numbers
# survive and malformed values can be cast with try_cast.
MESSAGE_FIELDS = READING_COLUMNS + ["message_id", "published_at"]

# Texts that stand for an absent measurement of a container sample (fixed values).
SAMPLE_DEFAULTS = {"cpu_percent": "0", "mem_used": "0", "net_io": "0 / 0"}
