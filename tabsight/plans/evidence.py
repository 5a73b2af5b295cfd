"""Everything a report prints as long rows, and an export that holds no row values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import targets
from ..operators.profile import union_all
from ..operators.roles import with_inspection
from .insight_run import TableProfile
from .model_run import RunResult, summary
from .score_run import ScoreResult

NO_ROWS = "section string, item string, metric string, value double, text string"


def long_rows(df: DataFrame, section: str, item: str | None = None) -> DataFrame:
    """``(section, item, metric, value, text)`` rows of a small table."""
    columns = [f for f in df.schema.fields if f.name != item]
    cells = []
    for f in columns:
        kind = f.dataType.simpleString()
        number = kind in ("double", "float", "int", "bigint", "boolean")
        value = F.col(f"`{f.name}`")
        cells.append(
            F.struct(
                F.lit(f.name).alias("metric"),
                (value.cast("int").cast("double") if kind == "boolean" else value.cast("double") if number else F.lit(None).cast("double")).alias("value"),
                (F.to_json(F.array(value) if not kind.startswith("array") else value) if kind.startswith("array") else value.cast("string")).alias("text"),
            )
        )
    key = F.col(f"`{item}`").cast("string") if item else F.lit(None).cast("string")
    return df.select(F.lit(section).alias("section"), key.alias("item"), F.explode(F.array(*cells)).alias("c")).select(
        "section", "item", "c.metric", "c.value", "c.text"
    )


def evidence_long(result: RunResult, scoring: ScoreResult | None = None) -> DataFrame:
    """Decision, findings, metrics, feature notes, drift and readiness in one long table."""
    parts = [long_rows(result.assessment, "decision", "column")]
    for section, item in (
        ("overview", None), ("findings", "rank"), ("paths", "analysis_type"), ("quality", "place"),
        ("column_profile", "column"), ("correlations", "column_a"), ("associations", "feature"),
    ):
        if section in result.evidence:
            parts.append(long_rows(result.evidence[section], section, item))
    if result.model is not None:
        parts.append(long_rows(summary(result), "validation", "source"))
        parts.append(long_rows(result.cv, "cross_validation", "model"))
    if scoring is not None:
        parts += [
            long_rows(scoring.evaluation, "external_evaluation"),
            long_rows(scoring.metrics, "external_metrics", "source"),
            long_rows(scoring.drift_numeric, "drift_numeric", "column"),
            long_rows(scoring.drift_categorical, "drift_categorical", "column"),
            long_rows(scoring.drift, "drift"),
            long_rows(scoring.readiness, "readiness"),
            long_rows(scoring.schema_warnings, "schema_warnings", "column"),
        ]
    notes = result.assessment.sparkSession.createDataFrame([(n,) for n in result.notes] or [], "note string")
    parts.append(long_rows(notes, "notes"))
    return union_all(parts)


def aggregate_export(table: TableProfile, max_columns: int = 12, max_targets: int = 5) -> DataFrame:
    """Allow-listed schema and statistics: no row values, labels, samples or texts."""
    inspected = with_inspection(table.roles)
    columns = inspected.orderBy("position").limit(max_columns).select(
        F.lit("column").alias("kind"), "column", "dtype", "role_hint",
        F.round((1 - F.col("missing_ratio")) * 100, 1).alias("coverage_pct"),
        F.round(F.col("missing_ratio") * 100, 1).alias("missing_pct"),
        F.col("distinct").alias("unique_values"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("problem_type"),
        F.lit(None).cast("double").alias("score"),
    )
    ranked = targets.ranked_candidates(targets.score_targets(table.roles)).where(F.col("status") != "rejected")
    candidates = ranked.orderBy("candidate_rank").limit(max_targets).select(
        F.lit("target").alias("kind"), "column", "dtype", F.lit(None).cast("string").alias("role_hint"),
        F.lit(None).cast("double").alias("coverage_pct"),
        F.round(F.col("missing_ratio") * 100, 1).alias("missing_pct"),
        F.col("distinct").alias("unique_values"), "status", "problem_type", "score",
    )
    return columns.unionByName(candidates)
