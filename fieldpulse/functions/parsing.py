"""Parsers for container samples and message time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed unit tables of the sample parsers (suffix, multiplier), checked in this order.
MEM_UNITS = (("GiB", 1024.0), ("MiB", 1.0), ("KiB", 1.0 / 1024.0), ("B", 1.0 / (1024.0 * 1024.0)))
NET_UNITS = (("GB", 1024.0), ("MB", 1.0), ("kB", 1.0 / 1024.0), ("B", 1.0 / (1024.0 * 1024.0)))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _scaled(text: Column, units) -> Column:
    """First matching suffix wins; the number before it times the unit, else 0."""
    expr = F.lit(0.0)
    for suffix, mult in reversed(units):
        body = F.substring(text, F.lit(1), F.length(text) - F.lit(len(suffix)))
        value = body.try_cast("double")
        scaled = value * F.lit(mult) if mult >= 1.0 else value / F.lit(1.0 / mult)
        expr = F.when(text.endswith(suffix), scaled).otherwise(expr)
    return expr


def parse_mem_mb(x) -> Column:
    """Memory in MiB from the part before ``/`` (``47.4MiB / 7.6GiB`` -> 47.4)."""
    used = F.trim(F.split_part(F.trim(_c(x)), F.lit("/"), F.lit(1)))
    return _scaled(used, MEM_UNITS)


def parse_net_mb(x) -> Column:
    """Sum over every ``/``-separated side of a network counter, in MB."""
    parts = F.split(_c(x), "/")
    return F.aggregate(
        F.transform(parts, lambda p: _scaled(F.trim(p), NET_UNITS)),
        F.lit(0.0), lambda acc, v: acc + v)


def parse_cpu(x) -> Column:
    """``12.5%`` -> 12.5."""
    return F.replace(F.trim(_c(x)), F.lit("%"), F.lit("")).try_cast("double")


def parse_published_at(x) -> Column:
    """ISO-8601 text to an instant; ``Z`` or no zone means UTC; bad text -> null.

    Returns a zone-less UTC wall-clock timestamp (TIMESTAMP_NTZ).
    """
    c = _c(x)
    parsed = F.try_to_timestamp(F.when(F.trim(c) != "", F.trim(c)))
    return parsed.cast("timestamp_ntz")
