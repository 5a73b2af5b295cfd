"""Order statistics and running totals that never put a whole column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import MAX_RANGES, VALUES_PER_TASK, value_ranges
from ..functions.text import col
from ..session import small_table
from .profile import union_all


def exact_quantiles(
    df: DataFrame, columns: dict, fractions: list[float], values_per_task: int = VALUES_PER_TASK
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of many expressions.

    ``columns`` maps a label to a double Column.  Rows collapse to value counts, running
    totals over the sorted counts locate every wanted rank, and only the rows that hold a
    wanted rank (at most two per fraction and column) reach the driver.
    """
    labels = list(columns)
    if not labels:
        return {}
    names = [f"q{i}" for i in range(len(labels))]
    counts = counts_of(df, {n: columns[k] for n, k in zip(names, labels, strict=True)})
    return dict(zip(labels, quantiles_of_counts(counts, names, fractions, values_per_task), strict=True))


def counts_of(df: DataFrame, columns: dict) -> DataFrame:
    """``name, x, n``: the distinct values of each double Column and how often each occurs; missing ones are left out."""
    frame = df.select(*[c.alias(n) for n, c in columns.items()])
    return union_all(
        [
            frame.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("x")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(n).alias("name"), "x", "n")
            for n in columns
        ]
    )


def median_and_mad(df: DataFrame, columns: dict, values_per_task: int = VALUES_PER_TASK) -> dict[str, tuple[float | None, float | None]]:
    """Exact median and median absolute deviation of many expressions, both from one grouping of the rows.

    Rows of the same value have the same distance, so the distances are those of the value counts.
    """
    labels = list(columns)
    names = [f"q{i}" for i in range(len(labels))]
    counts = fewer_partitions(counts_of(df, {n: columns[k] for n, k in zip(names, labels, strict=True)})).persist()
    middle = [m for (m,) in quantiles_of_counts(counts, names, [0.5], values_per_task)]
    known = [F.lit(v) for n, m in zip(names, middle, strict=True) if m is not None for v in (n, m)]
    if not known:
        counts.unpersist()
        return {k: (None, None) for k in labels}
    away = F.abs(F.col("x") - F.try_element_at(F.create_map(*known), F.col("name")))
    distances = counts.groupBy("name", away.alias("x")).agg(F.sum("n").alias("n"))
    mads = [m for (m,) in quantiles_of_counts(distances, names, [0.5], values_per_task)]
    counts.unpersist()
    return dict(zip(labels, zip(middle, mads, strict=True), strict=True))


def fewer_partitions(counts: DataFrame) -> DataFrame:
    """A union of many groupings merged to the partitions that one of them would have."""
    return counts.coalesce(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantiles_of_counts(
    counts: DataFrame, names: list[str], fractions: list[float], values_per_task: int = VALUES_PER_TASK
) -> list[list[float | None]]:
    """Exact quantiles for each of ``names`` from ``name, x, n``: the distinct values and how often each occurs."""
    counts = fewer_partitions(counts).persist()
    sizes = {
        r["name"]: r for r in counts.groupBy("name").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")).collect()
    }
    wanted = {}
    for n, size in sizes.items():
        places = [q * (size["rows"] - 1) for q in fractions]
        wanted[n] = sorted({int(p) for p in places} | {min(int(p) + 1, size["rows"] - 1) for p in places})
    if not wanted:
        counts.unpersist()
        return [[None] * len(fractions) for _ in names]
    ranks = F.create_map(*[x for n, w in wanted.items() for x in (F.lit(n), F.array(*[F.lit(i) for i in w]))])
    # Value ranges that hold none of the wanted ranks are left out before any row is sorted.
    totals = running_totals(
        counts, "x", ["n"], group=["name"], values_per_task=values_per_task,
        size=sum(r["values"] for r in sizes.values()),
        needed=F.exists(F.try_element_at(ranks, F.col("name")), lambda i: (i >= F.col("_o_n")) & (i < F.col("_o_n") + F.col("_t_n"))),
    )
    # A plain comparison per wanted rank discards almost every row before the lookup.
    holds = " OR ".join(
        f"(name = '{n}' AND (" + " OR ".join(f"({i} < cum_n AND {i} >= cum_n - n)" for i in w) + "))"
        for n, w in wanted.items()
    )
    first = F.col("cum_n") - F.col("n")
    hits = F.filter(F.try_element_at(ranks, F.col("name")), lambda i: (i >= first) & (i < F.col("cum_n")))
    found = totals.where(holds).select("name", "x", F.explode(hits).alias("rank")).collect()
    counts.unpersist()
    at = {(r["name"], r["rank"]): r["x"] for r in found}
    out: list[list[float | None]] = []
    for n in names:
        if n not in sizes:
            out.append([None] * len(fractions))
            continue
        values = []
        for q in fractions:
            place = q * (sizes[n]["rows"] - 1)
            low = at[n, int(place)]
            high = at[n, min(int(place) + 1, sizes[n]["rows"] - 1)]
            values.append(low + (place - int(place)) * (high - low))
        out.append(values)
    return out


def running_totals(
    df: DataFrame, order: str, sums: list[str], group: list[str] | None = None,
    descending: bool = False, values_per_task: int = VALUES_PER_TASK, size: int | None = None, needed: Column | None = None,
) -> DataFrame:
    """Running sums ``cum_<name>`` over rows already collapsed to distinct ``order`` values.

    Small inputs use one window.  Large ones are cut into value ranges taken from a
    quantile sketch; each range keeps its own window and gets the total of the ranges
    before it from a broadcast table of at most one row per range and group.  The ranges
    are plain value bounds, so a recomputed partition always lands in the same range.  With ``needed``, a
    condition on a range's total ``_t_<name>`` and the total before it ``_o_<name>``, rows of other ranges may be left out.
    """
    group = group or []
    total = df.count() if size is None else size
    # More ranges than this would only make the table of cuts large; bigger ranges sort
    # and spill inside their task.
    ranges = min(-(-total // values_per_task), MAX_RANGES)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if ranges <= 1:
        w = Window.partitionBy(*([col(g) for g in group] or [F.lit(1)])).orderBy(direction(order))
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(s).over(w).alias(f"cum_{s}") for s in sums])
    cut = value_ranges(df.withColumn(order, F.col(order).cast("double")), order, ranges)
    part = [*group, "_range"]
    totals = cut.groupBy(*part).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*([col(g) for g in group] or [F.lit(1)])).orderBy(direction("_range"))
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums], *[f"_t_{s}" for s in sums]
    )
    if needed is not None:
        offsets = offsets.where(needed)
    inside = Window.partitionBy(*part).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(offsets), part)
    return joined.select(
        *df.columns,
        *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
    )


def binary_curve(scored: DataFrame, score: str, positive: str, values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Distinct scores, best first, with true and false positives at each threshold."""
    points = (
        scored.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.col(positive).cast("bigint")).alias("pos"),
            F.sum(F.lit(1).cast("bigint") - F.col(positive).cast("bigint")).alias("neg"),
        )
        .persist()
    )
    return running_totals(points, "score", ["pos", "neg"], descending=True, values_per_task=values_per_task)


def curve_areas(curve: DataFrame) -> DataFrame:
    """Tie-aware ROC-AUC and step-wise average precision of a ``binary_curve``."""
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = curve.agg(
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
        # Negatives at this threshold lose to every positive above and tie with half of its own.
        F.sum(neg * (tp - pos + pos * 0.5)).alias("wins"),
        F.sum(pos * F.try_divide(tp, tp + fp)).alias("precision_steps"),
    )
    return sums.select(
        F.try_divide("wins", F.col("p") * F.col("n")).alias("roc_auc"),
        F.try_divide("precision_steps", F.col("p")).alias("average_precision"),
    )


def label_table(spark, values: dict[str, list], fractions: list[float], names: list[str]) -> DataFrame:
    """Quantile results as a small table, one row per label."""
    rows = [(k, *[None if x is None else float(x) for x in v]) for k, v in values.items()]
    return small_table(spark, rows, "column string, " + ", ".join(f"{n} double" for n in names))
