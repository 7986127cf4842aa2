"""The value at a rank by counting bit prefixes: no sort, no shuffle of values, no checkpoint.

A double's bits, read as a signed number, are in the order of the doubles.  The
value at a rank is found digit by digit: a histogram of the upper 22 bits
(counted within the tasks first) tells which prefix holds the rank; the values
with that prefix are counted by their next 21 bits, and those by the last 21.
Each histogram has at most as many rows as a digit has values, whatever the
number of values, distinct or not, and whatever the largest group.

Null values are left out; NaN counts as the greatest value (as Spark orders
it); both zeros are one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.numeric import mean_of, mean_parts, merged_parts

_DIGIT = 21                  # bits of the second and the third digit


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long that sorts as the double does (negative values by their negated bits)."""
    v = value.cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    two = F.lit(2.0)
    exponent = (F.when(F.pow(two, guess) > a, guess - 1).when(F.pow(two, guess + 1) <= a, guess + 1).otherwise(guess))
    fraction = ((a / F.pow(two, exponent) - 1) * F.lit(2.0 ** 52)).cast("long")                 # exact in each step
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    tiny = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")                             # below 2^-1022
    bits = (F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(a == F.lit(float("inf")), F.lit(2047 << 52))
            .when(a < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return F.when((v < 0) & ~F.isnan(v), -bits).otherwise(bits)


def floor_rank_index(n, q: float = 0.95) -> Column:
    """0-based index ``max(0, int(q*n) - 1)`` of the floor-rank percentile."""
    return F.greatest(F.lit(0), F.floor(F.lit(float(q)) * n.cast("double")) - F.lit(1))


def _digits(df: DataFrame, value_col: str, group_cols: list[str]) -> DataFrame:
    rows = df.where(F.col(value_col).isNotNull()).select(*group_cols, F.col(value_col).cast("double").alias("_v"))
    key = ordered_bits(F.col("_v"))
    low = F.lit((1 << _DIGIT) - 1)
    return rows.select(*group_cols, "_v", F.shiftright(key, 2 * _DIGIT).alias("_d1"),
                       F.shiftright(key, _DIGIT).bitwiseAND(low).alias("_d2"), key.bitwiseAND(low).alias("_d3"))


def _holding(histogram: DataFrame, group_cols: list[str], digit: str, rank: Column) -> DataFrame:
    """The bucket of each group that holds the rank, and the rank within it; the window runs over one row a digit value."""
    up = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy(digit)
    every = Window.partitionBy(*(group_cols or [F.lit(0)]))
    h = (histogram.withColumn("_upto", F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_total", F.sum("_n").over(every)).withColumn("_rank", rank))
    return h.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))).select(
        *group_cols, digit, (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_lo")


def _within(rows: DataFrame, target: DataFrame, keys: list[str], group_cols: list[str], digit: str) -> DataFrame:
    """Histogram by ``digit`` of the rows that have the target's digits; each of its rows has the rank looked for."""
    t = target.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "_rank")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    return rows.join(t, same).groupBy(*keys, digit).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_rank").alias("_rank"), F.min("_v").alias("_lo"))


def _pick(rows: DataFrame, histogram: DataFrame, group_cols: list[str], q: float, alias: str) -> DataFrame:
    first = _holding(histogram, group_cols, "_d1", floor_rank_index(F.col("_total"), q) + F.lit(1))
    keys = [*group_cols, "_d1"]
    second = _holding(_within(rows, first, keys, group_cols, "_d2"), keys, "_d2", F.col("_rank"))
    keys = [*keys, "_d2"]
    third = _holding(_within(rows, second, keys, group_cols, "_d3"), keys, "_d3", F.col("_rank"))
    return third.select(*group_cols, (F.col("_lo") + F.lit(0.0)).alias(alias))       # one value, -0.0 as 0.0


def floor_rank_pick(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), q: float = 0.95,
                    alias: str | None = None) -> DataFrame:
    """Per group, the value at sorted index ``max(0, int(q*n)-1)`` (exact).

    Not ``percentile_disc`` (ceil rank) nor ``percentile`` (interpolated).
    """
    group_cols = list(group_cols)
    rows = _digits(df, value_col, group_cols)
    histogram = rows.groupBy(*group_cols, "_d1").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"))
    return _pick(rows, histogram, group_cols, q, alias or f"p{int(round(q * 100))}")


def summary_with_floor_rank(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), q: float = 0.95) -> DataFrame:
    """Per group: n, mean, min, max and the floor-rank pick.

    The first histogram also carries the sums, so that one pass gives all but the pick's lower digits.
    """
    group_cols = list(group_cols)
    rows = _digits(df, value_col, group_cols)
    histogram = rows.groupBy(*group_cols, "_d1").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *mean_parts("_v"))
    stats = (histogram.groupBy(*group_cols) if group_cols else histogram.groupBy()).agg(
        F.sum("_n").alias("n"), *merged_parts(), F.min("_lo").alias("min"), F.max("_hi").alias("max"))
    stats = stats.select(*group_cols, "n", mean_of("n").alias("mean"), "min", "max")
    pick = _pick(rows, histogram, group_cols, q, "pick")
    if not group_cols:                                                      # one row with one row
        stats, pick, group_cols = stats.withColumn("_one", F.lit(1)), pick.withColumn("_one", F.lit(1)), ["_one"]
    same = F.lit(True)
    for k in group_cols:
        same = same & stats[k].eqNullSafe(pick[k])
    return stats.join(pick, same, "left").select(*[stats[c] for c in stats.columns if c != "_one"], "pick")
