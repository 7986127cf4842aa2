"""Drain and recovery watched live: a rule's summaries folded over the micro-batches of a sample stream.

    state/batch_id=N    one row a run: the summary of all its samples up to micro-batch N, and when it was reached
    hits/batch_id=N     the runs whose rule was first met in micro-batch N

A run's samples come in order: those of a micro-batch are later than those
before it (within a micro-batch they may come in any order).  A micro-batch
reads the state after the one before and writes its own folders, so one that is
run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.operators.run_summary import Rule
from fieldpulse.session import remove_path
from fieldpulse.streaming.buffer import read_if_there


class RunWatch:
    """``foreachBatch`` target that keeps a rule's summaries of every run under ``path``."""

    def __init__(self, spark: SparkSession, path: str, rule: Rule, group_cols: Sequence[str] = ("run",),
                 ts_col: str = "sample_ts", value_col: str = "value"):
        self.spark, self.path, self.rule = spark, path, rule
        self.group_cols, self.ts_col, self.value_col = list(group_cols), ts_col, value_col

    def _state(self, batch_id: int) -> DataFrame | None:
        return read_if_there(self.spark, f"{self.path}/state/batch_id={batch_id}")

    def last_batch(self) -> int:
        kept = read_if_there(self.spark, f"{self.path}/state")
        return -1 if kept is None else int(kept.agg(F.max("batch_id")).first()[0])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        piece = self.rule.summaries(batch, self.group_cols, self.ts_col, self.value_col)
        before = self._state(batch_id - 1) if batch_id else None
        if before is None and batch_id:                                  # a gap in the numbers
            kept = read_if_there(self.spark, f"{self.path}/state")
            prior = kept and kept.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
            before = None if prior is None else self._state(int(prior))
        self.rule.fold(before, piece, self.group_cols).write.mode("overwrite").parquet(f"{self.path}/state/batch_id={batch_id}")
        now = self._state(batch_id)
        met = now.where("summary.hit IS NOT NULL")
        if before is not None:
            met = met.join(before.where("summary.hit IS NOT NULL"), self.group_cols, "left_anti")
        (met.select(*self.group_cols, F.col("summary.hit").alias("index"), F.col("summary.value").alias("value"))
         .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/hits/batch_id={batch_id}"))
        if batch_id > 1:
            remove_path(self.spark, f"{self.path}/state/batch_id={batch_id - 2}")

    def state(self) -> DataFrame | None:
        """The summaries now: give them to ``run_summary.drained`` or ``recovered``."""
        last = self.last_batch()
        return None if last < 0 else self._state(last)

    def hits(self) -> DataFrame | None:
        """Each run whose rule has been met, once: its sample's index and value."""
        out = read_if_there(self.spark, f"{self.path}/hits")
        return None if out is None else out.drop("batch_id")
