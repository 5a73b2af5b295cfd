import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabsight.operators import clean, profile, roles, targets
from tabsight.session import small_table


def roles_of(df):
    frame = clean.sanitize(df)
    return frame, {r["column"]: r for r in roles.with_roles(profile.column_facts(frame)).collect()}


def test_missing_tokens_and_infinities_become_null(spark):
    df = spark.createDataFrame(
        [(" N/A ", float("inf")), (" none\t", float("nan")), (" x ", 1.0), ("--", -float("inf"))], "s string, x double"
    )
    rows = clean.sanitize(df).collect()
    assert [r["s"] for r in rows] == [None, None, "x", None]
    assert [r["x"] for r in rows] == [None, None, 1.0, None]


def test_headers_are_trimmed_and_must_stay_unique(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF(" a ", "a")
    with pytest.raises(ValueError, match="names repeat once trimmed"):
        clean.sanitize(df)
    assert clean.check_headers(["", " b "]) == ["Unnamed: 0", "b"]


def test_nested_columns_are_rejected(spark):
    with pytest.raises(ValueError, match="nested"):
        clean.sanitize(spark.range(1).select(F.array("id").alias("a")))


def test_exact_counts_and_target_candidate(spark):
    rows = [(i, float(i % 7) if i else None, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "CustomerID long, value double, Churn long")
    frame, by = roles_of(df)
    assert by["CustomerID"]["role"] == "identifier"
    assert by["value"]["non_null"] == 99 and by["value"]["distinct"] == 7
    assert by["Churn"]["problem_type"] == "classification"
    r = roles.with_roles(profile.column_facts(frame))
    first = targets.target_candidates(r).first()
    assert first["column"] == "Churn" and first["auto_select"]


def test_identifier_names_do_not_match_inside_words(spark):
    rows = [(i % 3, i % 5, i % 4, f"v{i % 6}") for i in range(60)]
    df = spark.createDataFrame(rows, "paid long, customer_id long, showid long, valid string")
    _, by = roles_of(df)
    assert not by["paid"]["is_identifier"] and not by["valid"]["is_identifier"]
    assert by["customer_id"]["is_identifier"] and by["showid"]["is_identifier"]


def test_sequences_are_identifiers_and_spread_numbers_are_not(spark):
    df = spark.range(1000).select(
        F.col("id").alias("seq"), (F.col("id") * 3).alias("steps"), (F.col("id") + 0.5).alias("shifted"),
        (F.col("id") * F.col("id")).alias("squares"),
    )
    _, by = roles_of(df.repartition(7))
    assert by["seq"]["is_identifier"] and by["seq"]["is_training_identifier"]
    assert not by["steps"]["is_identifier"] and not by["squares"]["is_identifier"]
    assert by["shifted"]["is_training_identifier"] and not by["shifted"]["is_identifier"]


def test_gap_counts_match_sorting(spark):
    import random

    rng = random.Random(3)
    values = sorted({round(rng.uniform(0, 300), 1) for _ in range(900)} | {float(i) for i in range(50)})
    df = spark.createDataFrame([(x,) for x in rng.sample(values, len(values))], "x double")
    close = sum(abs(b - a - 1) <= 1e-8 + 1e-5 for a, b in zip(values, values[1:]))
    assert profile.gap_facts(df, {"x": False}).first()["close_gaps"] == close
    whole = sorted({rng.randrange(500) for _ in range(300)})
    df = spark.createDataFrame([(float(x),) for x in whole], "x double")
    expected = sum(b - a == 1 for a, b in zip(whole, whole[1:]))
    assert profile.gap_facts(df, {"x": True}).first()["unit_gaps"] == expected
    assert profile.gap_facts(df, {"x": False}).first()["unit_gaps"] == expected


def test_long_text_is_measured_and_shown_in_full(spark):
    long = "word " * 60 + "end"
    df = spark.createDataFrame([(long,), (long,), ("short one",), (None,)], "t string")
    frame, by = roles_of(df)
    assert by["t"]["words"] == 61 * 2 + 2 and by["t"]["distinct"] == 2
    best = profile.resolve_text(frame, profile.top_values(frame, ["t"]), ["t"]).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in best] == [(long, 2), ("short one", 1)]


def test_long_numeric_text_counts_as_number(spark):
    df = spark.createDataFrame([("0." + "3" * 40,), ("12",), ("1e3",), ("1d",)], "t string")
    _, by = roles_of(df)
    assert by["t"]["numeric_ok"] == 3


def test_duplicates_respect_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (None, None), (None, None)], "a int, b int")
    assert profile.duplicate_rows(df).first()[0] == 2


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("s"))
    same = profile.fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()[0]
    assert profile.fingerprint(df).first()[0] == same
    assert profile.fingerprint(df.where("id > 0")).first()[0] != same
    assert profile.fingerprint(df.withColumnRenamed("s", "t")).first()[0] != same


def test_sample_is_deterministic(spark):
    df = spark.range(500)
    a = {r[0] for r in profile.hash_sample(df, ["id"], 50).collect()}
    b = {r[0] for r in profile.hash_sample(df.repartition(9), ["id"], 50).collect()}
    assert a == b and len(a) == 50


def test_empty_table_profiles(spark):
    df = spark.createDataFrame([], "a long, s string, b boolean, t timestamp_ntz")
    frame, by = roles_of(df)
    assert all(r["rows"] == 0 and r["distinct"] == 0 for r in by.values())
    r = roles.with_roles(profile.column_facts(frame))
    assert profile.overview(frame, r).first()["rows"] == 0


def test_positive_label_rules(spark):
    pick = lambda rows, asked=None: targets.positive_label(small_table(spark, rows, "label string, n bigint"), asked).collect()
    assert pick([("no", 5), ("yes", 90)])[0]["positive_label"] == "yes"
    assert pick([("0.0", 5), ("1.0", 90)])[0]["positive_label"] == "1.0"
    assert pick([("a", 5), ("b", 90)])[0]["positive_label"] == "a"
    assert pick([("a", 5), ("b", 5)])[0]["positive_label"] == "b"
    assert pick([("a", 5), ("b", 90)], "b")[0]["positive_label"] == "b"
    assert pick([("a", 5), ("b", 5), ("c", 1)]) == []


def test_related_targets_form_a_group(spark):
    rows = [(20 + i % 30, f"r{i % 4}", 100.0 + 1.5 * i, 130.0 + 2 * i, 90.0 + 3 * i) for i in range(120)]
    df = spark.createDataFrame(rows, "age long, region string, sales_q1 double, sales_q2 double, sales_q3 double")
    frame = clean.sanitize(df)
    r = roles.with_roles(profile.column_facts(frame))
    groups = targets.multi_target_groups(targets.score_targets(r)).collect()
    assert any(g["columns"] == "sales_q1, sales_q2, sales_q3" for g in groups)


def test_dates_in_text_are_a_date_role(spark):
    rows = [((dt.date(2021, 1, 1) + dt.timedelta(days=i)).strftime("%B %d, %Y"), "plain") for i in range(40)]
    _, by = roles_of(spark.createDataFrame(rows, "added string, other string"))
    assert by["added"]["is_date"] and by["added"]["role"] == "datetime"
    assert not by["other"]["is_date"]
    assert math.isclose(by["added"]["date_ratio"], 1.0)


def test_prediction_is_withdrawn_without_an_automatic_target(spark):
    scored = spark.createDataFrame(
        [("churned", "recommended", 4.0, ["churn"], "classification"), ("size", "possible", 3.5, [], "regression")],
        "column string, status string, score double, positive_words array<string>, problem_type string",
    )
    for auto in (True, False):
        row = targets.workflow(scored, spark.createDataFrame([(auto,)], "auto_select boolean")).first()
        assert row.recommended_workflow == ("prediction" if auto else "insights") and row.withdrawn is not auto
        assert row.primary_target == "churned" and not row.clear_primary_target
