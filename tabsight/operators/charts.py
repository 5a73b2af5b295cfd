"""Aggregated extracts for charts: which columns to show, histograms, level counts, a confusion
matrix and a bounded scatter sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import col
from ..session import small_table
from .metrics import confusion
from .profile import hash_sample

CHARTS_PER_KIND = 2
# A column or target with more levels than this is not drawn level by level.
MAX_CHART_LEVELS = 20


def histogram(df: DataFrame, name: str, target: str, buckets: int = 20) -> DataFrame:
    """Rows per equal-width bucket and target value; the bounds take one scan."""
    x = col(name).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    place = F.floor(F.try_divide(x - F.lit(low), F.lit(high) - F.lit(low)) * buckets)
    bucket = F.coalesce(F.least(place, F.lit(buckets - 1)), F.lit(0)).cast("bigint")
    return (
        df.where(col(name).isNotNull())
        .groupBy(bucket.alias("bucket"), col(target).cast("string").alias("target"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("column"), "bucket", "target", "n")
    )


def level_counts(df: DataFrame, name: str, target: str) -> DataFrame:
    """Rows per category level and target value."""
    return (
        df.groupBy(col(name).cast("string").alias("level"), col(target).cast("string").alias("target"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("column"), "level", "target", "n")
    )


def scatter_pairs(df: DataFrame, name: str, target: str, key: list[str], n: int = fv.MAX_CHART_ROWS) -> DataFrame:
    """A deterministic sample of feature-target pairs for a scatter chart."""
    rows = df.select(*[col(k) for k in key], col(name).alias("feature"), col(target).alias("target"))
    return hash_sample(rows, key, n)


def chart_features(
    df: DataFrame, roles: DataFrame, target: str, problem_type: str, importance: DataFrame | None = None,
    names: list[str] | None = None, per_kind: int = CHARTS_PER_KIND,
) -> DataFrame:
    """``kind, rank, column, basis``: at most ``per_kind`` numeric and categorical columns to draw.

    Columns go by ``importance`` (``feature, importance``) where it names any of their kind.  Otherwise numbers go
    by their absolute correlation with the target of a regression, or else in table order, and categories in
    table order if they have 2 to MAX_CHART_LEVELS levels.  Ties keep the table order; ``names`` are
    the columns to choose from, by default all that identify no row.
    """
    rule = F.col("column").isin(names) if names is not None else ~F.col("is_identifier")
    rows = roles.where(rule & (F.col("column") != target)).orderBy("position").select("column", "family", "distinct").collect()
    kinds = {
        "numeric": [r.column for r in rows if r.family in ("numeric", "boolean")],
        "categorical": [r.column for r in rows if r.family == "categorical"],
    }
    scores = {r.feature: r.importance for r in importance.select("feature", "importance").collect()} if importance is not None else {}
    out = []
    for kind, columns in kinds.items():
        chosen, basis = sorted((c for c in columns if scores.get(c) is not None), key=lambda c: -scores[c]), "importance"
        if not chosen and kind == "numeric" and problem_type == "regression":
            chosen, basis = _by_correlation(df, columns, target), "correlation"
        elif not chosen and kind == "numeric":
            chosen, basis = columns, "order"
        elif not chosen:
            chosen, basis = [r.column for r in rows if r.column in columns and 1 < r.distinct <= MAX_CHART_LEVELS], "order"
        out += [(kind, i, c, basis) for i, c in enumerate(chosen[:per_kind], 1)]
    return small_table(df.sparkSession, out, "kind string, rank int, column string, basis string")


def _by_correlation(df: DataFrame, names: list[str], target: str) -> list[str]:
    """Columns by absolute correlation with the target, one scan for all; those of two or fewer pairs do not take part."""
    if not names:
        return []
    y = col(target).cast("double")
    measures = []
    for i, c in enumerate(names):
        both = col(c).isNotNull() & y.isNotNull()
        x, other = F.when(both, col(c).cast("double")), F.when(both, y)
        # Not corr(): a constant side divides by zero there under ANSI rules.
        r = F.abs(F.try_divide(F.covar_pop(x, other), F.stddev_pop(x) * F.stddev_pop(other)))
        measures.append(F.struct(r.alias("r"), F.count(x).alias("n")).alias(f"_{i}"))
    found = df.agg(*measures).first()
    strength = {c: 0.0 if x.r is None or x.r != x.r else x.r for c, x in zip(names, found, strict=True) if x.n > 2}
    return sorted(strength, key=lambda c: -strength[c])


def confusion_matrix(scored: DataFrame, actual: str, predicted: str, max_levels: int = MAX_CHART_LEVELS) -> DataFrame:
    """``actual, predicted, n`` for all pairs of the actual classes, zeros too; no rows beyond ``max_levels`` classes.

    Rows with a prediction that is no actual class are not part of it.
    """
    counts = confusion(scored, actual, predicted)
    levels = [r.actual for r in counts.select("actual").distinct().limit(max_levels + 1).collect()]
    pairs = [(a, b) for a in sorted(levels) for b in sorted(levels)] if len(levels) <= max_levels else []
    grid = small_table(scored.sparkSession, pairs, "actual string, predicted string")
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def relationships(df: DataFrame, chosen: DataFrame, target: str, problem_type: str, key: list[str]) -> dict[str, DataFrame]:
    """Extract of each chosen column against the target: level counts of a category, a histogram by class of a
    number, and a sample of pairs where both are numbers."""
    out = {}
    for r in chosen.orderBy("kind", "rank").collect():
        if problem_type == "regression":
            out[r.column] = scatter_pairs(df, r.column, target, key)
        else:
            out[r.column] = (histogram if r.kind == "numeric" else level_counts)(df, r.column, target)
    return out
