"""File readers: readings CSV, container samples CSV, latency lists, group listings.

CSV files are read as text with their header and columns are picked by
name.  Spark binds the columns of every file of a folder by the first file's
header; a file with another header would have its columns swapped silently,
so every file's header is checked and a different one fails the read: read
the files of each header on their own and unite the frames by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from fieldpulse.schema import READING_FIELDS, SAMPLE_DEFAULTS

OFFSET_HEADER = ("PARTITION", "CURRENT-OFFSET", "LOG-END-OFFSET", "LAG")
# Fixed banner prefixes of a consumer-group listing.
LISTING_BANNERS = ("Consumer group", "Warning", "Note:")


def _typed_reading(col: str, dtype: T.DataType):
    if isinstance(dtype, T.StringType):
        return F.col(col)
    # plain (ANSI) cast: a value that does not convert fails the load
    return F.col(col).cast(dtype)


def _csv_with_one_header(spark: SparkSession, path) -> DataFrame:
    """The CSV files under ``path`` (or a list of paths) as text columns; all must have the same header."""
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_readings_csv(spark: SparkSession, path) -> DataFrame:
    """Readings from a header CSV, matched by column name.

    Missing columns become null, extra columns are ignored, numbers use the
    invariant ``.`` decimal point; an unconvertible value fails the job.
    """
    raw = _csv_with_one_header(spark, path)
    present = set(raw.columns)
    cols = [(_typed_reading(n, t) if n in present else F.lit(None).cast(t)).alias(n) for n, t in READING_FIELDS]
    return raw.select(*cols)


def read_stats_samples(spark: SparkSession, path: str) -> DataFrame:
    """Container samples CSV as text: timestamp, container, cpu_percent, mem_used, net_io.

    Without a ``container`` column the ``name`` column stands for it; names are
    trimmed; an absent or empty measurement has its default text.
    """
    raw = _csv_with_one_header(spark, path)
    present = set(raw.columns)

    def text(name: str, default: str | None = None):
        c = F.col(name) if name in present else F.lit(None).cast("string")
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)

    container = F.col("container") if "container" in present else F.col("name") if "name" in present else F.lit("")
    return raw.select(text("timestamp"), F.trim(F.coalesce(container, F.lit(""))).alias("container"),
                      *[text(n, d) for n, d in SAMPLE_DEFAULTS.items()])


def read_latencies(spark: SparkSession, path: str) -> DataFrame:
    """One latency per line; blank lines dropped; a missing file gives no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "latency_ms double")
    v = F.trim(F.col("value"))
    return lines.where(v != "").select(v.cast("double").alias("latency_ms"))


#: parts that the lines of one listing are dealt over
LISTING_PARTS = 64


def parse_offset_listing(lines: DataFrame, source_col: str = "source", value_col: str = "value") -> DataFrame:
    """Rows of a consumer-group listing: (source, partition, current, log end, lag).

    The header line holding ``CURRENT-OFFSET`` and ``LAG`` gives the column
    positions of its listing; it is joined to the data lines of the same
    source (one header per source), which are dealt over ``LISTING_PARTS`` parts,
    so that a long listing is not one task's work.  Banner lines and rows whose partition is
    not an integer are skipped; ``-`` is an absent value.
    """
    line = F.trim(F.replace(F.col(value_col), F.lit("\r"), F.lit("")))
    clean = lines.select(F.col(source_col).alias("source"), line.alias("line")).where(F.col("line") != "")
    tokens = F.split(F.col("line"), r"\s+")
    is_header = F.col("line").contains("CURRENT-OFFSET") & F.col("line").contains("LAG")
    header = (clean.where(is_header).groupBy("source").agg(F.min("line").alias("hline"))
              .select("source", *[F.array_position(F.split("hline", r"\s+"), h).alias(f"p{i}")
                                  for i, h in enumerate(OFFSET_HEADER)]))
    banner = F.lit(False)
    for b in LISTING_BANNERS:
        banner = banner | F.col("line").startswith(b)
    header = header.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LISTING_PARTS - 1))))
    part_of = F.pmod(F.xxhash64("line"), F.lit(LISTING_PARTS)).cast("int")
    data = (clean.where(~banner & ~is_header).withColumn("tok", tokens).withColumn("_part", part_of)
            .join(header, ["source", "_part"]))
    width = F.greatest(*[F.col(f"p{i}") for i in range(4)])
    complete = F.least(*[F.col(f"p{i}") for i in range(4)]) > 0

    def cell(i: int):
        v = F.element_at(F.col("tok"), F.col(f"p{i}").cast("int"))
        return F.when(v != "-", v)

    part = cell(0).try_cast("int")
    rows = data.where(complete & (F.size("tok") >= width) & part.isNotNull())
    return rows.select("source", part.alias("partition"),
                       cell(1).try_cast("long").alias("current_offset"),
                       cell(2).try_cast("long").alias("log_end_offset"),
                       cell(3).try_cast("long").alias("lag"))


def read_offset_listing(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("source", F.input_file_name())
    return parse_offset_listing(lines)
