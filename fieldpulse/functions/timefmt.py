"""Time arithmetic and formatting in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _micros(ts: Column) -> Column:
    # unix_micros refuses TIMESTAMP_NTZ; with the session zone in UTC the
    # cast keeps the wall clock.
    return F.unix_micros(ts.cast("timestamp"))


def add_millis(ts, millis) -> Column:
    """``ts + millis`` milliseconds, keeping microseconds; result is NTZ."""
    m = millis if isinstance(millis, Column) else F.lit(millis)
    return F.timestamp_micros(_micros(_c(ts)) + (m * F.lit(1000)).cast("long")).cast("timestamp_ntz")


def e2e_latency_ms(published, alert_at) -> Column:
    """Milliseconds (with fraction) from publication to alert; null if unknown."""
    return (_micros(_c(alert_at)) - _micros(_c(published))).cast("double") / F.lit(1000.0)


def latency_default(latency) -> Column:
    """An unknown latency is reported as 0.0."""
    return F.coalesce(_c(latency), F.lit(0.0))


def iso_format(ts) -> Column:
    """UTC ISO text as Python's ``isoformat()`` prints an aware datetime.

    ``2024-01-01T00:00:07.179575+00:00``; the fraction is left out when the
    instant is on a whole second.
    """
    c = _c(ts)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("+00:00"))


def batch_stamp(ts) -> Column:
    """Run stamp ``yyyyMMdd_HHmmss``."""
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


def stamp_second(ts) -> Column:
    """Instant cut to the whole second as ``yyyy-MM-ddTHH:mm:ss.000Z``."""
    return F.date_format(F.date_trunc("second", _c(ts)), "yyyy-MM-dd'T'HH:mm:ss.000'Z'")
