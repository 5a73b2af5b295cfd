"""Score a further table with a fitted model; evaluate, measure drift, decide readiness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators import scoring
from ..operators.clean import clean_value, coerce_numeric, family, sanitize
from ..operators.profile import column_facts
from ..operators.roles import with_roles
from ..operators.training import FittedModel, baseline_frame, evaluate, metric_row
from ..session import small_table


@dataclass
class References:
    """Training-side tables that drift is measured against."""

    numeric: list[str]
    moments: DataFrame
    shares: DataFrame
    identifiers: DataFrame | None
    identifier_columns: list[str]


@dataclass
class ScoreResult:
    scored: DataFrame
    prediction_column: str
    probability_columns: dict[str, str]
    schema_warnings: DataFrame
    evaluation: DataFrame
    metrics: DataFrame
    drift_numeric: DataFrame
    drift_categorical: DataFrame
    overlap: DataFrame
    drift: DataFrame
    readiness: DataFrame
    prevalence: DataFrame | None = None


def training_references(model: FittedModel) -> References:
    """Moments, category shares and identifiers of the training rows."""
    train = model.train
    names = model.features.required
    rows = sanitize(train.select(*[col(n) for n in names]))
    roles = with_roles(column_facts(rows))
    numeric = scoring.numeric_reference_columns(rows, roles, names)
    ids = model.features.learned.identifiers
    return References(
        numeric,
        scoring.column_moments(rows, names, numeric),
        scoring.category_shares(rows, [n for n in names if n not in numeric]),
        model.identifier_source.select(*[col(i) for i in ids]) if ids else None,
        ids,
    )


def save_references(refs: References, path: str) -> None:
    refs.moments.write.mode("overwrite").parquet(f"{path}/moments")
    refs.shares.write.mode("overwrite").parquet(f"{path}/shares")
    if refs.identifiers is not None:
        refs.identifiers.distinct().write.mode("overwrite").parquet(f"{path}/identifiers")


def load_references(spark, path: str) -> References:
    moments = spark.read.parquet(f"{path}/moments")
    numeric = [r["column"] for r in moments.where(F.col("kind") == "numeric").select("column").collect()]
    try:
        identifiers = spark.read.parquet(f"{path}/identifiers")
    except Exception:  # the table only exists for models with identifier columns
        identifiers = None
    return References(
        numeric, moments, spark.read.parquet(f"{path}/shares"), identifiers, identifiers.columns if identifiers else []
    )


def _external_labels(frame: DataFrame, target: str, model: FittedModel) -> tuple[DataFrame, DataFrame]:
    """Value counts of the external target mapped to training labels, and the gate row."""
    spark = frame.sparkSession
    value = _label_text(frame, target, model.labels)
    counts = (
        frame.select(value.cast("string").alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    labels = small_table(spark, [(v,) for v in model.labels], "label string")
    mapped = scoring.map_labels(counts, labels)
    return mapped, scoring.evaluation_gate(mapped, labels)


def _label_text(frame: DataFrame, target: str, labels: list[str]) -> Column:
    """External target values spelled as the training labels are: whole numbers without a point
    where the labels have none, as doubles where a label has one."""
    kind = frame.schema[target].dataType
    value = clean_value(target, kind)
    if family(kind) != "numeric":
        return value.cast("string")
    number = value.cast("double")
    if any("." in v for v in labels):
        return number.cast("string")
    return F.when(F.rint(number) == number, F.rint(number).cast("bigint").cast("string")).otherwise(number.cast("string"))


def score(model: FittedModel, df: DataFrame, refs: References) -> ScoreResult:
    """Every input row with prediction and probabilities, plus validation and drift."""
    if df.isEmpty():
        raise ValueError("nothing to score: the table is empty")
    spark = df.sparkSession
    target = model.config.target
    required = model.features.required
    known = [*required, *refs.identifier_columns, *model.config.key, target]
    aligned, warnings = scoring.align_schema(df, required, refs.numeric, known)
    keep = aligned.columns
    # Carried columns must not be cleaned, so features read their own copies.
    features = {n: f"_f:{n}" for n in required}
    wide = aligned.select(*[col(c) for c in keep], *[col(n).alias(f) for n, f in features.items()])
    predicted = _predict_beside(model, wide, keep, features)
    taken = set(keep)
    prediction = scoring.output_name("prediction", taken)
    names = {v: scoring.output_name(scoring.probability_name(v), taken) for v in model.labels}
    scored = predicted.select(
        *[col(c) for c in keep], F.col("_prediction").alias(prediction),
        *[F.col(f"_p{i}").alias(names[v]) for i, v in enumerate(model.labels)],
    )
    moments = scoring.column_moments(aligned, required, refs.numeric)
    drift_numeric = scoring.numeric_drift(refs.moments, moments)
    categorical = [n for n in required if n not in refs.numeric]
    drift_categorical = scoring.categorical_drift(refs.shares, scoring.category_shares(aligned, categorical))
    overlap = (
        scoring.identifier_overlap(aligned, refs.identifiers, refs.identifier_columns)
        if refs.identifiers is not None
        else small_table(spark, [], "column string, overlap_rows bigint, total_rows bigint, overlap_rate double")
    )
    drift = scoring.drift_level(drift_numeric, drift_categorical, overlap)
    status, metrics, baseline, rows = _evaluate(model, aligned, predicted, target)
    long_rows = [
        (source, k, None if v is None else float(v))
        for source, values in (("model", metrics), ("baseline", baseline))
        for k, v in values.items()
    ]
    metric = model.primary_metric
    shared = overlap.agg(F.coalesce(F.sum("overlap_rows"), F.lit(0))).first()[0]
    values = small_table(
        spark,
        [(model.holdout.get(metric), metrics.get(metric), baseline.get(metric), rows, int(shared), status.first()["evaluation_status"] == "blocked")],
        "internal double, external double, baseline double, rows bigint, overlap bigint, blocked boolean",
    )
    return ScoreResult(
        scored, prediction, names, warnings, status,
        small_table(spark, long_rows, "source string, metric string, value double"),
        drift_numeric, drift_categorical, overlap, drift, scoring.readiness(values, metric), _prevalence(model, aligned, target),
    )


def _prevalence(model: FittedModel, aligned: DataFrame, target: str) -> DataFrame | None:
    """Training and external rate of the positive label; none without labels or for other than class targets."""
    rate = model.baseline_strategy.get("positive_rate")
    if target not in aligned.columns or model.label is None or rate is None:
        return None
    training = small_table(aligned.sparkSession, [(float(rate),)], "training_rate double")
    spelled = aligned.select(_label_text(aligned, target, model.labels).alias(target))
    return scoring.prevalence_change(training, spelled, target, model.label)


def _predict_beside(model: FittedModel, wide: DataFrame, keep: list[str], features: dict[str, str]) -> DataFrame:
    """Predictions for rows whose feature copies sit beside the untouched columns."""
    carried = {c: f"_k{i}" for i, c in enumerate(keep)}
    frame = wide.select(
        *[col(c).alias(k) for c, k in carried.items()], *[col(f).alias(n) for n, f in features.items()]
    )
    out = model.predict(frame, list(carried.values()))
    return out.select(
        *[col(k).alias(c) for c, k in carried.items()],
        *[col(c) for c in out.columns if c not in carried.values()],
    )


def _evaluate(model: FittedModel, aligned: DataFrame, predicted: DataFrame, target: str):
    """Gate row, model and baseline metrics, and labelled rows; empty when not evaluated."""
    spark = aligned.sparkSession
    schema = "evaluation_status string, reason string"
    if target not in aligned.columns:
        return small_table(spark, [("not_requested", None)], schema), {}, {}, 0
    if model.problem_type == "regression":
        value = coerce_numeric(target, aligned.schema[target].dataType)
        given, usable = aligned.agg(F.count(clean_value(target, aligned.schema[target].dataType)), F.count(value)).first()
        reason = "no non-missing target labels" if not given else "some target values are not numeric" if usable < given else "fewer than 20 labeled rows" if usable < 20 else None
        status = small_table(spark, [("blocked" if reason else "completed", reason)], schema)
        if reason:
            return status, {}, {}, 0
        labelled = predicted.withColumn(target, value).where(col(target).isNotNull())
    else:
        mapped, gate = _external_labels(aligned, target, model)
        status = small_table(spark, [tuple(gate.select("evaluation_status", "reason").first())], schema)
        if status.first()["evaluation_status"] == "blocked":
            return status, {}, {}, 0
        names = {r["value"]: r["label"] for r in mapped.collect()}  # at most a few spellings per class
        value = _label_text(aligned, target, model.labels)
        spelled = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
        labelled = predicted.withColumn(target, F.try_element_at(spelled, value)).where(col(target).isNotNull())
    labelled = labelled.persist()
    metrics = evaluate(labelled, target, model.problem_type, model.labels, model.label)
    plain = labelled.select(*[col(c) for c in labelled.columns if c != "_prediction" and not c.startswith("_p")])
    base = evaluate(
        baseline_frame(plain, model.baseline_strategy, model.problem_type, model.labels, model.label),
        target, model.problem_type, model.labels, model.label,
    )
    labelled.unpersist()
    return status, metrics, base, int(metrics["support"])


def metrics_wide(result: ScoreResult) -> DataFrame:
    rows = {r["metric"]: r["value"] for r in result.metrics.where(F.col("source") == "model").collect()}
    return metric_row(result.metrics.sparkSession, rows)
