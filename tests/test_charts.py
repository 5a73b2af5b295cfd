"""Columns to draw and the confusion matrix."""

import pytest
from pyspark.sql import functions as F

from tabsight.operators import charts
from tabsight.operators.training import TrainingConfig, train_model
from tabsight.plans.insight_run import profile_table
from tabsight.plans.model_run import RunResult, chart_context


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    df = spark.range(60).select(
        "id", (i % 7).cast("double").alias("noise"), (i % 5).cast("double").alias("near"), F.when(i < 2, 1.0).alias("two"),
        (i % 2 == 0).alias("flag"), F.concat(F.lit("k"), i % 3).alias("kind"), F.concat(F.lit("w"), i % 30).alias("wide"), F.lit("c").alias("one"),
        (i % 5 + (i % 7) * 0.01).alias("y"),
    )
    return profile_table(df)


def chosen(table, *args, **kwargs):
    rows = charts.chart_features(table.frame, table.roles, "y", *args, **kwargs).orderBy("kind", "rank").collect()
    return [(r["kind"], r["column"], r["basis"]) for r in rows]


NAMES = ["noise", "near", "two", "flag", "kind", "wide", "one"]


def test_features_without_importance(table):
    assert chosen(table, "regression", names=NAMES)[:2] == [("categorical", "kind", "order"), ("numeric", "near", "correlation")]
    assert ("numeric", "two", "correlation") not in chosen(table, "regression", names=NAMES, per_kind=9)
    assert chosen(table, "classification", names=NAMES)[1:] == [("numeric", "noise", "order"), ("numeric", "near", "order")]
    assert chosen(table, "regression", names=[]) == []


def test_importance_comes_first_for_its_kind(spark, table):
    importance = spark.createDataFrame([("flag", 0.1), ("noise", 0.4), ("wide", -0.2), ("gone", 9.0)], "feature string, importance double")
    assert chosen(table, "regression", importance, NAMES) == [
        ("categorical", "wide", "importance"), ("numeric", "noise", "importance"), ("numeric", "flag", "importance")
    ]


def test_relationships(table):
    pick = charts.chart_features(table.frame, table.roles, "flag", "classification", names=["near", "kind"])
    found = charts.relationships(table.frame, pick, "flag", "classification", ["id"])
    assert set(found) == {"near", "kind"} and "level" in found["kind"].columns and "bucket" in found["near"].columns
    assert all(x.agg(F.sum("n")).first()[0] == 60 for x in found.values())
    pairs = charts.relationships(table.frame, pick, "y", "regression", ["id"])["near"]
    assert pairs.columns == ["id", "feature", "target"] and pairs.count() == 60


def test_confusion_matrix(spark):
    scored = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "z"), ("c", "c"), (None, "a")], "t string, p string")
    rows = {(r.actual, r.predicted): r.n for r in charts.confusion_matrix(scored, "t", "p").collect()}
    assert len(rows) == 9 and rows["a", "a"] == rows["a", "b"] == rows["c", "c"] == 1 and sum(rows.values()) == 3
    assert charts.confusion_matrix(scored, "t", "p", max_levels=2).count() == 0


def test_context_of_a_trained_model(spark):
    i = F.col("id")
    df = spark.range(240).select("id", (i % 17).cast("double").alias("x"), F.concat(F.lit("k"), i % 3).alias("kind"), F.when(i % 17 > 8, "a").otherwise("b").alias("t"))
    model = train_model(df, TrainingConfig("t", ("id",), boosting_rounds=3))
    result = RunResult("prediction", spark.range(1), {}, model)
    found = chart_context(result, profile_table(df), spark.createDataFrame([("x", 0.4)], "feature string, importance double"))
    assert {"features", "feature:x", "feature:kind", "confusion"} == set(found)
    rows = found["confusion"].collect()
    assert len(rows) == 4 and sum(r.n for r in rows) == model.holdout_rows
    assert chart_context(RunResult("analysis", spark.range(1), {}), profile_table(df)) == {}
