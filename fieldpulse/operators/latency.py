"""Alert latency summary (avg, min, max, floor-rank p95) and latency matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.numeric import round2, text2
from fieldpulse.operators.radix import floor_rank_pick, summary_with_floor_rank


def p95_floor_rank(latencies: DataFrame, value_col: str = "latency_ms",
                   group_cols: Sequence[str] = (), q: float = 0.95) -> DataFrame:
    return floor_rank_pick(latencies, value_col, group_cols, q, alias="p95_ms")


def latency_summary(latencies: DataFrame, value_col: str = "latency_ms",
                    group_cols: Sequence[str] = (), q: float = 0.95) -> DataFrame:
    """avg, min, max and floor-rank p95 of each group, rounded to 2 decimals.

    ``summary`` is the ``avg,min,max,p95`` line with two decimals.  Without
    groups an empty input gives one row of zeros.  The p95 is counted by bit
    prefixes, the others come with its first histogram (see ``radix``).
    """
    group_cols = list(group_cols)
    s = summary_with_floor_rank(latencies, value_col, group_cols, q)
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    avg = F.when(n > 0, F.col("mean"))
    cols = []
    for src, dst in ((avg, "avg_ms"), (F.col("min"), "min_ms"), (F.col("max"), "max_ms"), (F.col("pick"), "p95_ms")):
        cols.append(round2(F.coalesce(src, F.lit(0.0))).alias(dst))
    out = s.select(*group_cols, n.alias("n"), *cols)
    text = F.concat_ws(",", *[text2(c) for c in ("avg_ms", "min_ms", "max_ms", "p95_ms")])
    return out.withColumn("summary", text)


def latency_match(view: DataFrame, alert_col: str, group_cols: Sequence[str], order_cols: Sequence[str],
                  published_col: str = "published_at", latency_col: str = "e2e_latency_ms") -> DataFrame:
    """Accept a run's last alert latency only when it belongs to the last message sent.

    ``view`` holds the sent messages with an alert flag; ``accepted_latency_ms``
    is the last alert's latency when its ``published_at`` is that of the last
    message by ``order_cols``, else null.  One aggregation: the last message and the last alert (a ``max_by`` whose
    key is null for non-alert rows) come from the same partial aggregate,
    without a second scan or a join.
    """
    group_cols = list(group_cols)
    key = F.struct(*order_cols)
    g = view.groupBy(*group_cols).agg(
        F.max_by(F.col(published_col), key).alias("sent_published_at"),
        F.max_by(F.struct(F.col(published_col).alias("pa"), F.col(latency_col).alias("lat")),
                 F.when(F.col(alert_col), key)).alias("a"))
    match = F.coalesce(F.col("a.pa") == F.col("sent_published_at"), F.lit(False))
    return g.select(*group_cols, "sent_published_at", F.col("a.pa").alias("alert_published_at"),
                    match.alias("matched"), F.when(match, F.col("a.lat")).alias("accepted_latency_ms"))
