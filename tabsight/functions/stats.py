"""Column expressions for tests, intervals and multiplicity control."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hold

# Most rows one task may have to hold for an order over all of them.
VALUES_PER_TASK = 1_000_000
MAX_RANGES = 20_000

# Coefficients of the Chebyshev-fitted complementary error function (public
# numerical-analysis formula, relative error about 1e-7), highest power first.
ERFC_COEFFICIENTS = (
    0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
    -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
)


def erfc_positive(z: Column) -> Column:
    """Complementary error function for ``z >= 0``."""
    t = F.lit(1.0) / (F.lit(1.0) + z * F.lit(0.5))
    poly = reduce(lambda acc, k: acc * t + F.lit(k), ERFC_COEFFICIENTS[1:], F.lit(ERFC_COEFFICIENTS[0]))
    return t * F.exp(-z * z + poly)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value; 1 when the statistic is missing."""
    return F.coalesce(erfc_positive(F.abs(z) / F.sqrt(F.lit(2.0))), F.lit(1.0))


def correlation_p(r: Column, n: Column) -> Column:
    """Fisher-z p-value of a Pearson correlation over ``n`` pairs."""
    inner = F.when(F.abs(r) < 1, r)
    z = F.atanh(inner) * F.sqrt(F.greatest(n - 3, F.lit(0)).cast("double"))
    return (
        F.when(r.isNull() | (n < 4), F.lit(1.0))
        .when(F.abs(r) >= 1, F.lit(0.0))
        .otherwise(two_sided_p(z))
    )


def wilson_bounds(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]."""
    n = total.cast("double")
    rate = F.try_divide(successes.cast("double"), n)
    denominator = F.lit(1.0) + F.try_divide(F.lit(z * z), n)
    center = (rate + F.try_divide(F.lit(z * z), n * 2)) / denominator
    radius = (
        F.lit(z)
        * F.sqrt(F.try_divide(rate * (1 - rate), n) + F.try_divide(F.lit(z * z), n * n * 4))
        / denominator
    )
    return F.greatest(F.lit(0.0), center - radius), F.least(F.lit(1.0), center + radius)


def value_ranges(df: DataFrame, order: str, ranges: int) -> DataFrame:
    """``df`` with ``_range``, the place of ``order`` among about ``ranges`` value ranges of even size.

    The bounds come from a quantile sketch and are plain values, so a recomputed partition always lands in the
    same range; missing values are a range of their own below all others, as in an ascending order.
    """
    probs = [i / ranges for i in range(1, ranges)]
    inner = sorted(set(df.approxQuantile(order, probs, 1.0 / (4 * ranges))))
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol="_range", handleInvalid="keep").transform(df)
    return cut.withColumn("_range", F.when(F.col(order).isNull(), F.lit(-1.0)).otherwise(F.col("_range")))


def adjust_p(
    rows: DataFrame, p: str = "p_value", out: str = "adjusted_p_value", size: int | None = None, values_per_task: int = VALUES_PER_TASK
) -> DataFrame:
    """Benjamini-Hochberg step-up over all given rows, one row a test.

    Ranks are counted from the smallest value and minima from the largest, so every frame only grows and a
    row is visited once; equal values share the last of their ranks, which is where their minimum lies.
    ``size`` is a bound on the number of rows where the caller knows one; otherwise the rows are held and counted.
    Many rows are cut into value ranges, each with its own windows and what the other ranges add to them.
    """
    held = size is None
    if held:
        rows = hold(rows)
        size = rows.count()
    ranges = min(-(-size // values_per_task), MAX_RANGES)
    if ranges <= 1:
        everything = Window.partitionBy(F.lit(1))
        ranked = rows.withColumn("_m", F.count(F.lit(1)).over(everything)).withColumn(
            "_rank", F.count(F.lit(1)).over(everything.orderBy(F.asc(p)))
        )
        stepped = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(everything.orderBy(F.desc(p)))
        return ranked.withColumn(out, F.least(F.lit(1.0), stepped)).drop("_m", "_rank")
    cut = value_ranges(rows if held else hold(rows), p, ranges)
    place, inside = Window.partitionBy(F.lit(1)), Window.partitionBy("_range")
    below = place.orderBy(F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    above = place.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.sum("_n").over(place).alias("_m"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    rank = F.count(F.lit(1)).over(inside.orderBy(F.asc(p))) + F.col("_below")
    ranked = cut.join(F.broadcast(sizes), "_range").withColumn("_step", F.col(p) * F.col("_m") / rank)
    lows = ranked.groupBy("_range").agg(F.min("_step").alias("_low")).select("_range", F.min("_low").over(above).alias("_above"))
    stepped = ranked.join(F.broadcast(lows), "_range").withColumn("_own", F.min("_step").over(inside.orderBy(F.desc(p))))
    return stepped.withColumn(out, F.least(F.lit(1.0), F.col("_own"), F.col("_above"))).select(*rows.columns, out)
