"""Folding a stored table's folders: many small ones, one for each micro-batch, become segments.

    rows/is_valid=../batch_id=N, counts/batch_id=N    what micro-batch N wrote
    segments/gen=G/rows, segments/gen=G/counts        micro-batches folded by fold G
    manifest/gen=G                                    the segments, and the newest micro-batch in them

A fold writes a new segment and then a new manifest: this is the swap.  A
reader takes the newest manifest's segments and the folders of the micro-batches
after it, so it sees every row once before, during and after a fold.  Folders
are deleted a fold later, so that a reader which started before still finds
them.  Each row is rewritten once.  The newest micro-batch, which may run again,
is never folded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.session import remove_path
from fieldpulse.streaming.buffer import read_if_there


@dataclass(frozen=True)
class Manifest:
    gen: int = -1
    upto: int = -1
    segments: tuple[int, ...] = ()


def newest(spark: SparkSession, path: str) -> Manifest:
    kept = read_if_there(spark, f"{path}/manifest")
    if kept is None:
        return Manifest()
    r = kept.agg(F.max_by(F.struct("gen", "upto", "segments"), "gen").alias("m")).first().m
    return Manifest(int(r.gen), int(r.upto), tuple(r.segments))


def _later(spark: SparkSession, path: str, part: str, upto: int) -> DataFrame | None:
    """What the micro-batches after ``upto`` wrote."""
    df = read_if_there(spark, f"{path}/{part}")
    if df is None:
        return None
    df = df.withColumn("batch_id", F.col("batch_id").cast("long")).where(F.col("batch_id") > upto)
    return df.withColumn("is_valid", F.col("is_valid").cast("boolean")) if "is_valid" in df.columns else df


def table(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``rows`` or ``counts`` of all micro-batches, folded or not."""
    m = newest(spark, path)
    parts = [read_if_there(spark, f"{path}/segments/gen={g}/{part}") for g in m.segments]
    parts.append(_later(spark, path, part, m.upto))
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.read.parquet(f"{path}/{part}")               # says that there is none
    if "is_valid" in parts[0].columns:                            # a partition value is read back as text
        parts = [p.withColumn("is_valid", F.col("is_valid").cast("boolean")) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold(spark: SparkSession, path: str) -> Manifest:
    """Fold all micro-batches but the newest; returns the manifest that now holds."""
    old = newest(spark, path)
    counts = _later(spark, path, "counts", old.upto)
    last = None if counts is None else counts.agg(F.max("batch_id")).first()[0]
    upto = -1 if last is None else int(last) - 1
    if upto <= old.upto:
        return old
    gen = old.gen + 1
    segment = f"{path}/segments/gen={gen}"
    done = F.col("batch_id") <= upto
    rows = _later(spark, path, "rows", old.upto)
    if rows is not None:
        # small files are read many to a task, and each task writes one file of either kind
        rows.where(done).write.mode("overwrite").partitionBy("is_valid").parquet(f"{segment}/rows")
    counts.where(done).coalesce(1).write.mode("overwrite").parquet(f"{segment}/counts")
    (spark.createDataFrame([(upto, [*old.segments, gen])], "upto long, segments array<long>").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest/gen={gen}"))
    every = read_if_there(spark, f"{path}/counts")
    gone = [r.batch_id for r in every.where(F.col("batch_id") <= old.upto).select("batch_id").distinct().collect()]
    for n in gone:                                                # folded by an earlier fold: no reader needs them now
        for folder in (f"rows/is_valid=true/batch_id={n}", f"rows/is_valid=false/batch_id={n}", f"counts/batch_id={n}"):
            remove_path(spark, f"{path}/{folder}")
    if gen > 1:
        remove_path(spark, f"{path}/manifest/gen={gen - 2}")
    return Manifest(gen, upto, (*old.segments, gen))
