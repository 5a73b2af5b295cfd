"""Profile once, then derive every descriptive result lazily from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import insights, profile, roles, targets
from ..operators.clean import sanitize
from ..session import small_table


@dataclass
class TableProfile:
    """A sanitized table and its one-row-per-column facts with roles."""

    frame: DataFrame
    roles: DataFrame

    @property
    def overview(self) -> DataFrame:
        return profile.overview(self.frame, self.roles)


def profile_table(df: DataFrame) -> TableProfile:
    frame = sanitize(df)
    return TableProfile(frame, roles.with_roles(profile.column_facts(frame)))


def resolve_label(frame: DataFrame, target: str, requested: str | None = None) -> str | None:
    """Positive label of a binary target; None for any other target."""
    counts = insights.label_counts(frame, target).orderBy(F.desc("n"), "label").limit(3).collect()
    if len(counts) != 2:
        if requested is not None:
            raise ValueError("label= needs a target with exactly two values")
        return None
    if requested is not None and requested not in [r["label"] for r in counts]:
        raise ValueError(f"label {requested!r} does not occur in the target")
    return targets.positive_label(
        small_table(frame.sparkSession, counts, "label string, n bigint"), requested
    ).first()["positive_label"]


def target_evidence(table: TableProfile, target: str | None, label: str | None) -> dict[str, DataFrame]:
    """The results whose meaning depends on the target."""
    out = {"groups": insights.group_summary(table.frame, table.roles, target)}
    if target is not None and label is not None:
        ranked = insights.target_associations(table.frame, table.roles, target, label)
        out["associations"] = ranked
        out["target_overview"] = insights.target_overview(table.frame, target, label)
        out["perfect_levels"] = insights.perfect_levels(ranked)
    return out


def rank(table: TableProfile, evidence: dict[str, DataFrame]) -> dict[str, DataFrame]:
    overview = evidence["overview"]
    return {
        "paths": insights.analysis_paths(evidence, overview, table.roles),
        "findings": insights.findings(evidence, overview, evidence["categorical_summary"]),
    }


def run_insights(
    table: TableProfile, key: list[str], target: str | None = None, label: str | None = None
) -> dict[str, DataFrame]:
    """All evidence tables of one profiled table, each a lazy DataFrame."""
    frame, r = table.frame, table.roles
    found = targets.association_target(r, target).first()
    target = found["association_target"] if found else None
    label = resolve_label(frame, target, label) if target else None
    overview = table.overview
    out = {
        "overview": overview,
        "column_profile": roles.column_profile(r),
        "column_inspection": insights.column_inspection(frame, r),
        "numeric_summary": insights.numeric_summary(frame, r),
        "categorical_summary": insights.categorical_summary(frame, r),
        "correlations": insights.correlations(frame, r),
        "anomalies": insights.anomaly_rows(frame, r, key),
        "multi_values": insights.multi_values(frame, r),
        "units": insights.unit_summary(frame, r),
        "quality": insights.quality_statements(r, overview),
        "sensitive_columns": roles.sensitive_columns(r),
    }
    dates = insights.trend_column(r)
    if dates:
        out["trend"] = insights.trend(frame, dates)
        out["trend_change"] = insights.trend_change(out["trend"])
    out.update(target_evidence(table, target, label))
    out.update(rank(table, out))
    return out


def retarget(
    table: TableProfile, results: dict[str, DataFrame], target: str, label: str | None = None
) -> dict[str, DataFrame]:
    """Replace only what depends on the target; everything else is reused as it is."""
    label = resolve_label(table.frame, target, label)
    kept = {k: v for k, v in results.items() if k not in ("associations", "target_overview", "perfect_levels")}
    kept.update(target_evidence(table, target, label))
    kept.update(rank(table, kept))
    return kept


def workflow(table: TableProfile) -> DataFrame:
    return targets.workflow(targets.score_targets(table.roles), targets.target_candidates(table.roles))


def recommend_targets(table: TableProfile, top: int = 5) -> DataFrame:
    """The leading target candidates with fit, suggested task and reasons."""
    ranked = targets.ranked_candidates(targets.score_targets(table.roles))
    reasons = F.slice(F.concat("pros", "cautions"), 1, 3)
    return (
        ranked.where(F.col("status") != "rejected")
        .orderBy("candidate_rank")
        .limit(top)
        .select(
            "column", "score", F.initcap("status").alias("workflow_fit"),
            F.coalesce("problem_type", F.lit("Insights")).alias("suggested_task"),
            F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(F.col("summary")).alias("reasons"),
        )
    )
