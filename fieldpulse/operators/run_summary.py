"""Summaries of pieces of a sample series that can be merged: drain, recovery streak and first recovery, live.

A piece of a run is any number of its samples in a row.  Its summary holds what
the rules need of it: the length of the run of good samples that it begins
with and of the one that it ends with, its first and last value, and where a
long enough run of good samples was first complete.  Merging is associative,
so a series may be cut anywhere (by micro-batches, by tasks) and gives the
same answer as :mod:`recovery` gives for the whole.

Two rules: ``equal`` (a sample is good if it equals the one before) and
``limit`` (a sample is good if its value is at most the limit).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.operators.recovery import _since_break

SUMMARY = "struct<n:bigint,first:bigint,last:bigint,lead:bigint,trail:bigint,hit:bigint,value:bigint>"


@dataclass(frozen=True)
class Rule:
    """``needed`` good samples in a row; with a ``limit`` small values are good, without one repeated values are."""

    needed: int
    limit: int | None = None

    def _breaks(self, value: Column, previous: Column) -> Column:
        return value != previous if self.limit is None else value > F.lit(self.limit)

    def summaries(self, samples: DataFrame, group_cols: Sequence[str] = ("run",), ts_col: str = "sample_ts",
                  value_col: str = "value") -> DataFrame:
        """(group columns, summary) of the samples, one piece for each run."""
        group_cols = list(group_cols)
        piece = samples.select(*group_cols, ts_col, F.col(value_col).cast("long").alias(value_col))
        f = _since_break(piece, group_cols, ts_col, value_col, self._breaks)
        idx = F.col("idx").cast("long")
        # without a limit a piece's first sample has none before it and counts as a break
        broken = F.min(F.when((F.col("held") == 0) & (idx > F.lit(0 if self.limit is None else -1)), idx))
        n, offset = F.count(F.lit(1)), F.lit(1 if self.limit is None else 0)
        hit = F.min(F.when(F.col("held") >= self.needed, idx))
        value = F.min_by("value", F.when(F.col("held") >= self.needed, idx)) if self.limit is None else F.lit(None)
        return f.groupBy(*group_cols).agg(F.struct(
            n.alias("n"), F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"),
            (F.coalesce(broken, n) - offset).alias("lead"), F.max_by("held", "idx").cast("long").alias("trail"),
            hit.alias("hit"), value.cast("long").alias("value")).cast(SUMMARY).alias("summary"))

    def merge(self, a: Column, b: Column) -> Column:
        """The summary of a piece and the one right after it; null stands for no samples."""
        if self.limit is None:
            joined = F.coalesce(a["last"] == b["first"], F.lit(False))
            run = a["trail"] + 1 + b["lead"]
            whole_a, whole_b = a["lead"] == a["n"] - 1, b["trail"] == b["n"] - 1
        else:
            joined = b["lead"] > 0
            run = a["trail"] + b["lead"]
            whole_a, whole_b = a["lead"] == a["n"], b["trail"] == b["n"]
        across = joined & (run >= self.needed) & (a["trail"] < self.needed)
        both = F.struct(
            (a["n"] + b["n"]).alias("n"), a["first"].alias("first"), b["last"].alias("last"),
            F.when(whole_a & joined, a["n"] + b["lead"]).otherwise(a["lead"]).alias("lead"),
            F.when(whole_b & joined, a["trail"] + b["n"]).otherwise(b["trail"]).alias("trail"),
            F.coalesce(a["hit"], F.when(across, a["n"] + F.lit(self.needed) - a["trail"] - 1), a["n"] + b["hit"]).alias("hit"),
            F.when(a["hit"].isNotNull(), a["value"]).when(across & F.lit(self.limit is None), b["first"])
            .otherwise(b["value"]).alias("value")).cast(SUMMARY)
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)

    def fold(self, state: DataFrame | None, piece: DataFrame, group_cols: Sequence[str] = ("run",)) -> DataFrame:
        """The summaries after another piece of the runs; one row a run on either side."""
        if state is None:
            return piece
        group_cols = list(group_cols)
        old = state.select(*group_cols, F.col("summary").alias("_old"))
        return old.join(piece, group_cols, "full").select(*group_cols, self.merge(F.col("_old"), F.col("summary")).alias("summary"))


def drained(state: DataFrame, group_cols: Sequence[str] = ("run",), timeout: int | None = None) -> DataFrame:
    """The result of :func:`recovery.drain_stable` from the summaries of a rule without a limit."""
    hit = F.col("summary.hit")
    late = hit.isNull() if timeout is None else hit.isNull() | (hit >= F.lit(int(timeout)))
    return state.select(*group_cols, hit.alias("drained_index"), F.col("summary.value").alias("drained_value"),
                        late.alias("timed_out"))


def recovered(state: DataFrame, group_cols: Sequence[str] = ("run",), horizon: int = 180) -> DataFrame:
    """The result of :func:`recovery.recovery_streak` from the summaries of a rule with a limit."""
    hit = F.col("summary.hit")
    text = F.when(hit < F.lit(horizon), (hit + 1).cast("string")).otherwise(F.lit(f"{horizon}+"))
    return state.select(*group_cols, hit.alias("recovery_index"), text.alias("recovery_s"))
