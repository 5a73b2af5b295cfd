"""Leakage screening: columns that give the target away before training starts.

Each screen is one aggregate over the rows (or one grouping per column) and ends in one
row per column; ``screen`` unions them and keeps the first excluding rule per column.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import col, has_any, name_tokens_camel, unit_name, unit_number
from ..session import beside, small_table
from .clean import coerce_datetime, coerce_numeric, family
from .ordered import running_totals
from .profile import union_all
from .roles import pick

REPORT_SCHEMA = "column string, rule string, action string, evidence double"

ORDER_BLOCK_ROWS = 100_000
MAX_ORDER_BLOCKS = 10_000


def _as_text(name: str) -> Column:
    return col(name).cast("string")


def _report(df: DataFrame, rule: str, action: Column | str) -> DataFrame:
    action = F.lit(action) if isinstance(action, str) else action
    return df.select("column", F.lit(rule).alias("rule"), action.alias("action"), "evidence")


def _one_row_per_column(df: DataFrame, names: list[str], **measures) -> DataFrame:
    """One aggregate over all columns, unfolded to one row per column."""
    wide = df.agg(
        *[
            F.struct(F.lit(n).alias("column"), *[m(n).alias(k) for k, m in measures.items()]).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))


def copies(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Share of rows equal to the target as text, over rows where both are present."""
    both = lambda n: col(n).isNotNull() & col(target).isNotNull()
    shares = _one_row_per_column(
        df, names,
        paired=lambda n: F.count_if(both(n)),
        equal=lambda n: F.count_if(both(n) & (_as_text(n) == _as_text(target))),
        total=lambda n: F.count(F.lit(1)),
    )
    return shares.select(
        "column", "paired",
        F.try_divide("equal", "paired").alias("evidence"),
        (
            (F.col("paired") >= F.greatest(F.lit(20), F.floor(F.col("total") * 0.5)))
            & (F.try_divide("equal", "paired") >= 0.999)
        ).alias("flagged"),
    )


def suspicious_names(facts: DataFrame, target: str) -> DataFrame:
    """Columns that share a word with the target and sound recorded after the outcome."""
    tokens = name_tokens_camel(F.col("column"))
    shared = F.arrays_overlap(tokens, name_tokens_camel(F.lit(target)))
    return facts.where((F.col("column") != target) & shared & has_any(tokens, fv.POST_OUTCOME_WORDS)).select("column")


def separator_auc(df: DataFrame, target: str, label: str, names: list[str]) -> DataFrame:
    """Exact tie-aware AUC of every numeric column against a binary target.

    Rows collapse to value counts first, so running totals only see distinct values.
    """
    if not names:
        return small_table(df.sparkSession, [], "column string, paired bigint, auc double, evidence double, flagged boolean")
    parts = [
        df.select(coerce_numeric(n, df.schema[n].dataType).alias("x"), (_as_text(target) == label).alias("yes"))
        .where(F.col("x").isNotNull() & F.col("yes").isNotNull())
        .groupBy("x")
        .agg(F.count_if("yes").alias("pos"), F.count_if(~F.col("yes")).alias("neg"))
        .select(F.lit(n).alias("column"), "x", "pos", "neg")
        for n in names
    ]
    run = running_totals(union_all(parts).persist(), "x", ["neg"], group=["column"])
    sums = run.groupBy("column").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") * 0.5)).alias("wins"),
    )
    auc = F.try_divide("wins", F.col("p").cast("double") * F.col("q"))
    return sums.select("column", (F.col("p") + F.col("q")).alias("paired"), auc.alias("auc")).withColumn(
        "evidence", F.greatest("auc", 1 - F.col("auc"))
    ).withColumn("flagged", F.coalesce((F.col("paired") >= 20) & (F.col("evidence") >= 0.999), F.lit(False)))


def _order_number(df: DataFrame, name: str) -> Column:
    kind = family(df.schema[name].dataType)
    if kind == "datetime":
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if kind != "numeric":
        raise ValueError(f"Order column {name} must be numeric or a timestamp.")
    return col(name).cast("double")


def time_order(df: DataFrame, names: list[str], order_by: list[str] | None) -> DataFrame:
    """Whether dates only rise or only fall along the caller's row order.

    Monotone means: no later row holds an earlier date.  Rows are grouped into order blocks of about
    equal row counts, cut at quantiles of the order so that an outlying value changes nothing, each block keeps its first, last and inner breaks, and only
    the few block ends are compared in order.  Without an order nothing is checked.
    """
    schema = "column string, paired bigint, evidence double, flagged boolean"
    if not order_by or not names:
        return small_table(df.sparkSession, [], schema)
    key = order_by[0]
    numbers = df.select(_order_number(df, key).alias("o"))
    total = numbers.agg(F.count("o")).first()[0]
    if not total:
        return small_table(df.sparkSession, [], schema)
    blocks = max(1, min(MAX_ORDER_BLOCKS, total // ORDER_BLOCK_ROWS))
    cuts = sorted(set(numbers.approxQuantile("o", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)))) if blocks > 1 else []
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    block_of = Bucketizer(splits=splits, inputCol="o", outputCol="block", handleInvalid="keep")
    parts = []
    for n in names:
        rows = block_of.transform(
            df.select(
                *[col(k).alias(f"k{i}") for i, k in enumerate(order_by)], _order_number(df, key).alias("o"),
                coerce_datetime(n, df.schema[n].dataType).alias("ts"),
            ).where(F.col("ts").isNotNull())
        )
        inner = Window.partitionBy("block").orderBy(*[f"k{i}" for i in range(len(order_by))])
        steps = rows.withColumn("before", F.lag("ts").over(inner))
        place = F.struct(*[f"k{i}" for i in range(len(order_by))])
        ends = steps.groupBy("block").agg(
            F.min_by("ts", place).alias("first"), F.max_by("ts", place).alias("last"), F.count(F.lit(1)).alias("n"),
            F.bool_and(F.coalesce(F.col("ts") >= F.col("before"), F.lit(True))).alias("rising"),
            F.bool_and(F.coalesce(F.col("ts") <= F.col("before"), F.lit(True))).alias("falling"),
        )
        outer = Window.partitionBy(F.lit(1)).orderBy("block")
        joined = ends.withColumn("before", F.lag("last").over(outer))
        parts.append(
            joined.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("paired"),
                (
                    F.bool_and(F.col("rising") & F.coalesce(F.col("first") >= F.col("before"), F.lit(True)))
                    | F.bool_and(F.col("falling") & F.coalesce(F.col("first") <= F.col("before"), F.lit(True)))
                ).alias("monotone"),
            ).select(
                F.lit(n).alias("column"), "paired", F.col("monotone").cast("double").alias("evidence"),
                F.coalesce((F.col("paired") >= 20) & F.col("monotone"), F.lit(False)).alias("flagged"),
            )
        )
    return union_all(parts)


def numeric_copies(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Absolute correlation with a regression target, in one aggregate."""
    y0 = coerce_numeric(target, df.schema[target].dataType)
    x0 = lambda n: coerce_numeric(n, df.schema[n].dataType)
    frame = df.select(y0.alias("_y"), *[x0(n).alias(n) for n in names])
    y = lambda n: F.when(col(n).isNotNull(), F.col("_y"))
    x = lambda n: F.when(F.col("_y").isNotNull(), col(n))
    spread = lambda n: F.stddev_pop(x(n)) * F.stddev_pop(y(n))
    out = _one_row_per_column(
        frame, names,
        paired=lambda n: F.count(x(n)),
        evidence=lambda n: F.when(spread(n) > 0, F.abs(F.try_divide(F.covar_pop(x(n), y(n)), spread(n)))),
    )
    return out.withColumn(
        "flagged", F.coalesce((F.col("paired") >= 20) & (F.col("evidence") >= 0.9995), F.lit(False))
    )


def _purity(pairs: DataFrame, name: str) -> DataFrame:
    """Weighted purity of a feature's levels over target classes, from ``(f, t)`` rows."""
    counts = pairs.where(F.col("f").isNotNull() & F.col("t").isNotNull()).groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.agg(F.count_distinct("t").alias("target_levels"))
    levels = counts.groupBy("f").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    totals = levels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("paired"), F.count(F.lit(1)).alias("levels"),
        F.try_divide(F.sum("top"), F.sum("n")).alias("evidence"),
    )
    return beside(totals, classes).select(F.lit(name).alias("column"), "paired", "levels", "target_levels", "evidence")


def level_purity(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Columns whose levels almost determine the class."""
    parts = [_purity(df.select(_as_text(n).alias("f"), _as_text(target).alias("t")), n) for n in names]
    limit = F.least(F.lit(50), F.greatest(F.lit(2), F.floor(F.col("paired") / 5)))
    return union_all(parts).withColumn(
        "flagged",
        (F.col("paired") >= 20) & (F.col("target_levels") >= 2) & F.col("levels").between(F.col("target_levels"), limit)
        & (F.col("evidence") >= 0.999),
    )


def unit_purity(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Text columns whose unit almost determines the class."""
    schema = "column string, paired bigint, levels bigint, target_levels bigint, evidence double, flagged boolean"
    if not names:
        return small_table(df.sparkSession, [], schema)
    number = lambda n: unit_number(col(n), fv.UNIT_FEATURE_PATTERN)
    covered = _one_row_per_column(
        df, names, covered=lambda n: F.try_divide(F.count(number(n)), F.count(F.lit(1)))
    ).where(F.col("covered") >= 0.8)
    open_names = [r["column"] for r in covered.select("column").collect()]
    if not open_names:
        return small_table(df.sparkSession, [], schema)
    parts = [
        _purity(
            df.select(F.lower(unit_name(col(n), fv.UNIT_FEATURE_PATTERN)).alias("f"), _as_text(target).alias("t")), n
        )
        for n in open_names
    ]
    return union_all(parts).withColumn(
        "flagged",
        F.col("levels").between(2, 20) & (F.col("paired") >= 20) & (F.col("evidence") >= 0.995),
    )


def screen(
    df: DataFrame, roles: DataFrame, target: str, problem_type: str,
    label: str | None = None, order_by: list[str] | None = None,
) -> DataFrame:
    """Every finding as ``(column, rule, action, evidence)``; action is exclude or review."""
    features = [c for c in df.columns if c != target]
    tokens = name_tokens_camel(F.col("column"))
    shares = F.arrays_overlap(tokens, name_tokens_camel(F.lit(target)))
    parts = [_report(copies(df, target, features).where("flagged"), "target copy", "exclude")]
    named = suspicious_names(roles, target).withColumn("evidence", F.lit(None).cast("double"))
    parts.append(_report(named, "recorded after outcome", "exclude"))
    numeric_like = [c for c in pick(roles, (F.col("numeric_ratio") >= 0.95) & F.col("family").isin("numeric", "categorical", "boolean")) if c != target]
    dates = [c for c in pick(roles, F.col("is_date")) if c != target]
    if problem_type == "classification" and label is not None and numeric_like:
        found = separator_auc(df, target, label, numeric_like).where("flagged")
        action = F.when(shares | has_any(tokens, fv.DERIVED_OUTCOME_WORDS), "exclude").otherwise("review")
        parts.append(_report(found, "near-perfect separator", action))
    parts.append(_report(time_order(df, dates, order_by).where("flagged"), "time-ordered rows", "review"))
    if problem_type == "regression" and numeric_like:
        parts.append(_report(numeric_copies(df, target, numeric_like).where("flagged"), "numeric copy", "exclude"))
    if problem_type == "classification":
        derived = [c for c in pick(roles, has_any(tokens, fv.DERIVATION_NAME_WORDS)) if c != target]
        if derived:
            parts.append(_report(level_purity(df, target, derived).where("flagged"), "deterministic levels", "exclude"))
        text = [c for c in pick(roles, F.col("family") == "categorical") if c != target]
        parts.append(_report(unit_purity(df, target, text).where("flagged"), "unit reveals class", "exclude"))
    order = [
        "target copy", "recorded after outcome", "near-perfect separator", "time-ordered rows",
        "numeric copy", "deterministic levels", "unit reveals class",
    ]
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("rule"))
    # A column that a rule excludes is not examined by the rules after it.
    stop = F.min(F.when(F.col("action") == "exclude", F.col("place"))).over(Window.partitionBy("column"))
    return (
        union_all(parts).withColumn("place", place).withColumn("stop", stop)
        .where(F.col("stop").isNull() | (F.col("place") <= F.col("stop")))
        .select("column", "rule", "action", "evidence")
    )


def overlap_rows(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """How many rows carry an identifier that also occurs in ``known``.

    Both sides collapse to distinct identifiers before the semi join, so a hot identifier
    costs one row on either side.
    """
    total = F.sum("n").alias("total_rows")
    counted = rows.groupBy(_as_text(name).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    ids = known.select(_as_text(name).alias("id")).where(F.col("id").isNotNull()).distinct()
    hits = counted.join(ids.withColumn("hit", F.lit(1)), "id", "left")
    return hits.agg(
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("overlap_rows"), total
    ).select(
        F.lit(name).alias("column"), "overlap_rows", F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce(F.try_divide("overlap_rows", "total_rows"), F.lit(0.0)).alias("overlap_rate"),
    )


def entity_overlap(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Shared entities of two splits for every column whose name holds the token id."""
    spark = train.sparkSession
    both = small_table(spark, [(c,) for c in train.columns if c in holdout.columns], "column string")
    names = [r["column"] for r in both.where(F.array_contains(name_tokens_camel(F.col("column")), "id")).collect()]
    if not names:
        return small_table(spark, [], "column string, overlap_rows bigint, total_rows bigint, overlap_rate double")
    return union_all([overlap_rows(holdout, train, n) for n in sorted(names)])
