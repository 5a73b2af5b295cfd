"""Evaluation: confusion counts, averaged scores, exact curve areas, thresholds, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, safe_ratio
from ..session import beside
from .ordered import binary_curve, curve_areas


def confusion(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per (actual, predicted) pair, as text labels."""
    return (
        scored.select(col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted"))
        .where(F.col("actual").isNotNull())
        .groupBy("actual", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classification_metrics(counts: DataFrame) -> DataFrame:
    """One row of accuracy and averaged precision, recall and F1 from confusion counts."""
    sides = counts.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")).unionByName(
        counts.select(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hits"))
    )
    per_label = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
    p = safe_ratio(F.col("hits"), F.col("guessed"))
    r = safe_ratio(F.col("hits"), F.col("support"))
    f1 = safe_ratio(2 * F.col("hits"), F.col("support") + F.col("guessed"))
    weight = F.col("support")
    average = lambda c: F.sum(c * weight) / F.sum(weight)
    return per_label.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, r)).alias("balanced_accuracy"),
        average(p).alias("precision"), average(r).alias("recall"), average(f1).alias("f1"),
        F.avg(f1).alias("f1_macro"),
        F.sum("support").alias("support"),
    )


def ranking_metrics(scored: DataFrame, actual: str, score: str, label: str) -> DataFrame:
    """Step-wise average precision and tie-aware ROC-AUC of a score, exactly."""
    flagged = scored.where(col(actual).isNotNull()).select(
        col(score).alias("score"), (col(actual).cast("string") == label).cast("int").alias("positive")
    )
    return curve_areas(binary_curve(flagged, "score", "positive"))


def best_threshold(scored: DataFrame, actual: str, score: str, label: str) -> DataFrame:
    """Threshold with the best F1 on the precision-recall curve; ties take the lowest."""
    flagged = scored.where(col(actual).isNotNull()).select(
        col(score).alias("score"), (col(actual).cast("string") == label).cast("int").alias("positive")
    )
    curve = binary_curve(flagged, "score", "positive")
    total = flagged.agg(F.sum("positive")).first()[0] or 0
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, F.lit(total))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return curve.select("score", f1.alias("f1")).agg(
        F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("best_f1")
    )


def regression_metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    pair = scored.select(y.alias("y"), p.alias("p")).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    error = F.col("y") - F.col("p")
    return pair.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop("y"))).alias("r2"),
        F.count(F.lit(1)).alias("support"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of every class and the smallest share."""
    counts = (
        df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    return beside(counts, total).select(
        "label", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("least") / F.col("total")).alias("smallest_share")
    )


def baseline_classification(train: DataFrame, actual: str, label: str | None) -> DataFrame:
    """Majority label (ties: smallest text) and training positive rate, one row."""
    counts = (
        train.where(col(actual).isNotNull()).groupBy(col(actual).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    most = counts.agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    return beside(counts, most).agg(
        F.min(F.when(F.col("n") == F.col("most"), F.col("label"))).alias("majority_label"),
        (F.sum(F.when(F.col("label") == F.lit(label), F.col("n")).otherwise(0)) / F.max("total")).alias("positive_rate"),
    )


def constant_predictions(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows with the values of the one-row baseline attached as constants."""
    values = baseline.first().asDict()
    return rows.select("*", *[F.lit(v).alias(k) for k, v in values.items()])


def quality_verdict(model: DataFrame, baseline: DataFrame, problem_type: str) -> DataFrame:
    """Verdict of one-row model metrics against one-row baseline metrics."""
    m = model.select([F.col(c).alias(f"m_{c}") for c in model.columns])
    b = baseline.select([F.col(c).alias(f"b_{c}") for c in baseline.columns])
    both = beside(m, b)
    if problem_type == "classification":
        ranked = "average_precision" in model.columns and "average_precision" in baseline.columns
        primary = F.col("m_average_precision") if "average_precision" in model.columns else F.col("m_f1")
        base = F.col("b_average_precision") if "average_precision" in baseline.columns else F.col("b_f1")
        f1_gain = F.col("m_f1") - F.col("b_f1")
        gain = primary - base if ranked else f1_gain
        verdict = (
            F.when((primary >= 0.8) & ((f1_gain >= 0.15) | (gain >= 0.15)), "strong")
            .when((primary >= 0.6) & ((f1_gain >= 0.05) | (gain >= 0.05)), "useful")
            .otherwise("weak")
        )
        return both.select(
            verdict.alias("verdict"), f1_gain.alias("primary_delta"), F.col("m_f1").alias("best_metric"), F.col("b_f1").alias("baseline_metric")
        )
    gain = (F.col("b_rmse") - F.col("m_rmse")) / F.greatest("b_rmse", F.lit(1e-9))
    r2 = F.col("m_r2")
    verdict = (
        F.when((r2 >= 0.7) & (gain >= 0.15), "strong")
        .when((r2 >= 0.45) & (gain >= 0.08), "useful")
        .when((r2 >= 0.25) & (gain >= 0.05), "limited")
        .otherwise("weak")
    )
    return both.select(
        verdict.alias("verdict"), gain.alias("primary_delta"), F.col("m_rmse").alias("best_metric"), F.col("b_rmse").alias("baseline_metric")
    )

