"""The supervised run: decide, train, judge, and fall back to insights when weak."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts, targets
from ..operators.training import FittedModel, TrainingConfig, cv_table, train_model
from .insight_run import TableProfile, profile_table, run_insights


@dataclass
class RunResult:
    """Mode (prediction or analysis), reasons, evidence and, if trained, the model."""

    mode: str
    assessment: DataFrame
    evidence: dict[str, DataFrame]
    model: FittedModel | None = None
    cv: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def assessment(table: TableProfile, target: str) -> DataFrame:
    """The decision row of one target."""
    scored = targets.score_targets(table.roles).where(F.col("column") == target)
    return scored.select(
        "column", "status", "score", "problem_type", "mode_recommendation", "blockers", "assess_blockers",
        "reasons_for", "reasons_against", "usable_feature_count",
    )


def run(df: DataFrame, config: TrainingConfig, table: TableProfile | None = None, with_insights: bool = True) -> RunResult:
    """Profile, assess the target, train when it is workable, and judge the result."""
    table = table or profile_table(df)
    decision = assessment(table, config.target)
    row = decision.first()
    if row is None:
        raise ValueError(f"no column {config.target!r} to predict")
    evidence = run_insights(table, list(config.key), config.target) if with_insights else {}
    if row["status"] == "rejected" or row["mode_recommendation"] != "prediction":
        return RunResult("analysis", decision, evidence, notes=list(row["blockers"] or row["assess_blockers"]))
    model = train_model(df, config)
    notes = [f"{c}: {rule} ({action})" for c, rule, action, _ in model.features.learned.leakage]
    notes += [
        f"{name}: {hits:,}/{total:,} holdout rows hold a value of the training rows"
        for name, hits, total, _ in model.overlaps
    ]
    if model.selection_metric == "average_precision":
        notes.append("rare class: ranked by average precision")
    notes.append("no external evaluation yet")
    mode = "analysis" if model.verdict == "weak" else "prediction"
    return RunResult(mode, decision, evidence, model, cv_table(df.sparkSession, model), notes)


def chart_context(result: RunResult, table: TableProfile, importance: DataFrame | None = None) -> dict[str, DataFrame]:
    """Extracts to draw a trained result: chosen features, their relationships (``feature:<name>``) and the confusion matrix."""
    m = result.model
    if m is None:
        return {}
    target, key = m.config.target, list(m.config.key)
    inputs = [c for c in m.features.required if c in table.frame.columns]
    chosen = charts.chart_features(table.frame, table.roles, target, m.problem_type, importance, inputs)
    out = {"features": chosen}
    out |= {f"feature:{c}": x for c, x in charts.relationships(table.frame, chosen, target, m.problem_type, key).items()}
    if m.problem_type == "classification":
        out["confusion"] = charts.confusion_matrix(m.predict(m.test, [*key, target]), target, "_prediction")
    return out


def summary(result: RunResult) -> DataFrame:
    """Holdout and baseline metrics of the chosen model in long form."""
    from ..session import small_table

    m = result.model
    spark = result.assessment.sparkSession
    schema = "source string, metric string, value double, model string, verdict string, mode string"
    if m is None:
        return small_table(spark, [], schema)
    rows = [
        (source, k, None if v is None else float(v), m.name, m.verdict, result.mode)
        for source, metrics in (("holdout", m.holdout), ("baseline", m.baseline))
        for k, v in metrics.items()
    ]
    return small_table(spark, rows, schema)
