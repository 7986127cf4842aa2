"""Numeric helpers: rounding, NaN-safe comparison, loss and backlog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text2(x) -> Column:
    """Two-decimal text of the exact binary value, ties to even (``%.2f``)."""
    return F.call_function("format_number", _c(x), F.lit("0.00"))


def round2(x) -> Column:
    """Rounding to two decimals as Python's ``round`` does: the exact binary
    value, ties to even.  Non-finite and null inputs pass through."""
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c).otherwise(text2(c).cast("double"))


def safe_gt(x, threshold) -> Column:
    """Strict ``x > threshold`` that is false for NaN (Spark orders NaN last)."""
    c = _c(x)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (c > thr) & ~F.isnan(c)


def loss_pct(sent, received) -> Column:
    """``(sent - received) * 100 / sent``; 0 when nothing was sent."""
    s, r = _c(sent), _c(received)
    return F.when(s <= 0, F.lit(0.0)).otherwise(
        (s - r).cast("double") * F.lit(100.0) / s.cast("double"))


def py_repr2(x) -> Column:
    """Text of a value rounded to two decimals, as a Python float prints it.

    ``%.2f`` then one trailing zero dropped: 12.50 -> 12.5, 30.00 -> 30.0.
    """
    return F.regexp_replace(text2(x), "0$", "")


def loss_pct_text(sent, received) -> Column:
    """Two-decimal loss text ("0.00" when nothing was sent)."""
    return text2(loss_pct(sent, received))


def clamped_backlog(received, stored, baseline=0) -> Column:
    """``max(received - stored - baseline, 0)``."""
    b = baseline if isinstance(baseline, Column) else F.lit(int(baseline))
    return F.greatest(_c(received) - _c(stored) - b, F.lit(0))


EXACT = "decimal(38,18)"


def mean_parts(x, name: str = "") -> list[Column]:
    """Partial aggregates for :func:`mean_of`: ``<name>_exact``, ``<name>_double``, ``<name>_odd``.

    Values whose decimal text fits ``EXACT`` are also summed exactly, so a
    mean does not depend on the order rows are added in (partition layout,
    merge order).  ``_odd`` tells that some value does not fit; nothing is
    rounded or refused for it, the mean is then the plain double one.
    """
    c = _c(x)
    exact = c.try_cast(EXACT)
    odd = c.isNotNull() & ~F.coalesce(exact.cast("double") == c, F.lit(False))
    return [F.try_sum(exact).alias(f"{name}_exact"), F.sum(c).alias(f"{name}_double"), F.max(odd).alias(f"{name}_odd")]


def merged_parts(name: str = "") -> list[Column]:
    """The same aggregates over partial results (a second level, or a later merge)."""
    return [F.try_sum(f"{name}_exact").alias(f"{name}_exact"), F.sum(f"{name}_double").alias(f"{name}_double"),
            F.max(F.col(f"{name}_odd") | F.col(f"{name}_exact").isNull()).alias(f"{name}_odd")]


def mean_of(count, name: str = "") -> Column:
    """The unrounded mean from the parts and the row count."""
    total = F.col(f"{name}_exact")
    usable = total.isNotNull() & ~F.coalesce(F.col(f"{name}_odd"), F.lit(False))
    return F.when(usable, total.cast("double")).otherwise(F.col(f"{name}_double")) / _c(count).cast("double")
