"""Tumbling windows closed once, behind the frontier of committed micro-batches.

The state between micro-batches is one small table: the mergeable aggregates of
the windows that are still open.  Micro-batch N folds its own aggregates into
the open windows of N - 1, closes those that ended by its frontier, and writes
what it closed, its alerts, and what stays open:

    parts/state=open/batch_id=N      open windows after micro-batch N
    parts/state=closed/batch_id=N    aggregates of the windows that it closed
    parts/state=late/batch_id=N      rows of windows closed before: set aside, never emitted again
    stats/batch_id=N, alerts/batch_id=N    statistics and alert records of what it closed
    commits/batch_id=N               its frontier and late rows, written last

The frontier is the newest time that a committed micro-batch has seen, less
``delay``.  On arrival time every row of a micro-batch carries the time of its
trigger, so no row of a later one, the one in flight included, can be older.
Windows are closed inside the micro-batch, not by a second thread that would
have to guess what is in flight.  A heartbeat (``jobs.with_heartbeat``) gives a
micro-batch to every trigger, so that windows close on time in an idle stream.

A micro-batch reads the open windows and the commit of the one before only, and
writes its own folders, so one that is run again changes nothing.
"""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.operators import alerts as AL
from fieldpulse.operators import windows as W
from fieldpulse.schema import WINDOW_ALERT_THRESHOLD, WINDOW_SECONDS
from fieldpulse.session import remove_path
from fieldpulse.streaming.buffer import read_if_there

def interval_seconds(size: str) -> int:
    n, unit = size.split()[:2]
    per = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(float(n) * per[unit.rstrip("s").lower()])


class WindowStore:
    """Windows of ``size`` under ``path``.

    ``in_order``: times never fall behind those of earlier micro-batches by
    more than ``delay_s`` (as arrival times do not); windows then close as the
    frontier passes them.  Otherwise they stay open until :meth:`finish`.
    """

    def __init__(self, spark: SparkSession, path: str, size: str = f"{WINDOW_SECONDS} seconds",
                 threshold: float = WINDOW_ALERT_THRESHOLD, time_col: str = "arrival_ts", start: str | None = None,
                 in_order: bool = True, delay_s: float = 0.0):
        self.spark, self.path, self.size, self.threshold = spark, path, size, threshold
        self.time_col, self.start, self.in_order, self.delay_s = time_col, start, in_order, delay_s
        self._one_at_a_time = threading.Lock()

    # ---- state
    def last_batch(self) -> int:
        """The newest committed micro-batch, or -1."""
        commits = read_if_there(self.spark, f"{self.path}/commits")
        return -1 if commits is None else int(commits.agg(F.max("batch_id")).first()[0])

    def _before(self, batch_id: int) -> tuple[int, dt.datetime | None, bool]:
        """The commit before, its frontier, and whether all its windows were emitted by :meth:`finish`."""
        prior = batch_id - 1
        row = read_if_there(self.spark, f"{self.path}/commits/batch_id={prior}") if batch_id else None
        if row is None:                                 # the first one, or a gap in the numbers
            commits = read_if_there(self.spark, f"{self.path}/commits") if batch_id else None
            found = commits and commits.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
            if found is None:
                return -1, None, True
            prior, row = int(found), read_if_there(self.spark, f"{self.path}/commits/batch_id={int(found)}")
        frontier = row.first().frontier
        final = read_if_there(self.spark, f"{self.path}/finals/batch_id={prior}")
        if final is None:
            return prior, frontier, False
        if read_if_there(self.spark, f"{self.path}/alerts/batch_id={prior}/emitted=final") is None:
            self._emit(self._open(prior), prior, "final")           # completes one that died half way
        ends = [t for t in (frontier, final.first().frontier) if t is not None]
        return prior, max(ends) if ends else None, True

    def frontier(self) -> dt.datetime | None:
        """Windows that ended by this time are closed."""
        return self._before(self.last_batch() + 1)[1]

    def _part(self, state: str, batch_id: int) -> DataFrame | None:
        return read_if_there(self.spark, f"{self.path}/parts/state={state}/batch_id={batch_id}")

    def _open(self, batch_id: int) -> DataFrame | None:
        return self._part("open", batch_id)

    # ---- writing
    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch``: fold the micro-batch in, close what its frontier has passed."""
        with self._one_at_a_time:
            prior, passed, done = self._before(batch_id)
            part = W.window_partials_and_clock(batch, self.size, self.time_col, start=self.start)
            bounds = F.struct(F.col("window.start").cast("timestamp_ntz").alias("start"),
                              F.col("window.end").cast("timestamp_ntz").alias("end"))
            fresh = f"{self.path}/fresh"
            (part.withColumn("window", bounds).withColumn("newest", F.col("newest").cast("timestamp_ntz"))
             .write.mode("overwrite").parquet(fresh))                        # the pass over the rows
            rows = self.spark.read.parquet(fresh)
            frontier = self._next(passed, rows.agg(F.max("newest")).first()[0])
            rows = rows.where("count > 0").drop("newest")
            late = F.lit(False) if passed is None else F.col("window.end") <= F.lit(passed)
            closed = F.lit(False) if frontier is None else F.col("window.end") <= F.lit(frontier)
            held = None if done else self._open(prior)
            both = rows if held is None else rows.unionByName(held.select(*rows.columns))
            state = F.when(late, "late").when(closed, "closed").otherwise("open")
            (W.merge_partials(both).withColumn("state", state).withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("state", "batch_id").parquet(f"{self.path}/parts"))
            self._emit(self._part("closed", batch_id), batch_id, "closed")
            set_aside = self._part("late", batch_id)
            n_late = 0 if set_aside is None else int(set_aside.agg(F.sum("count")).first()[0])
            self._commit(f"commits/batch_id={batch_id}", frontier, n_late)
            if prior > 0:
                remove_path(self.spark, f"{self.path}/parts/state=open/batch_id={prior - 1}")

    def _next(self, passed, now):
        if not self.in_order or now is None:
            return passed
        now = now - dt.timedelta(seconds=self.delay_s)
        return now if passed is None else max(now, passed)

    def _commit(self, where: str, frontier, late: int) -> None:
        (self.spark.createDataFrame([(frontier, late)], "frontier timestamp_ntz, late_rows long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/{where}"))

    def _emit(self, closed: DataFrame | None, batch_id: int, kind: str) -> None:
        if closed is None:
            return
        stats = W.stats_of(closed, self.threshold).coalesce(1)               # windows that one micro-batch closed
        place = f"batch_id={batch_id}/emitted={kind}"
        stats.write.mode("overwrite").parquet(f"{self.path}/stats/{place}")
        written = self.spark.read.parquet(f"{self.path}/stats/{place}")
        (AL.alert_records_window(W.window_alerts(written), interval_seconds(self.size)).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/alerts/{place}"))

    def finish(self) -> None:
        """Emit the windows that are still open, for a stream that has ended; later rows of these are set aside."""
        with self._one_at_a_time:
            last = self.last_batch()
            if last < 0 or self._before(last + 1)[2]:
                return
            waiting = self._open(last)
            end = None if waiting is None else waiting.agg(F.max("window.end")).first()[0]
            self._commit(f"finals/batch_id={last}", end, 0)                  # the intent; the next call completes it
            self._emit(waiting, last, "final")

    # ---- reading
    def _emitted(self, what: str) -> DataFrame | None:
        out = read_if_there(self.spark, f"{self.path}/{what}")
        return None if out is None else out.drop("batch_id", "emitted")

    def stats(self) -> DataFrame | None:
        """Statistics of all windows emitted so far, each once; None before the first."""
        return self._emitted("stats")

    def alerts(self) -> DataFrame | None:
        """Alert records of the emitted windows whose mean exceeds the threshold; None before the first window."""
        return self._emitted("alerts")

    def open_windows(self) -> DataFrame | None:
        """Aggregates of the windows that are still open."""
        last = self.last_batch()
        return None if last < 0 or self._before(last + 1)[2] else self._open(last)

    def late_rows(self) -> int:
        """Rows that came after their window was closed."""
        commits = read_if_there(self.spark, f"{self.path}/commits")
        return 0 if commits is None else int(commits.agg(F.sum("late_rows")).first()[0])
