import random

import pytest
from pyspark.sql import functions as F

from tabsight.operators import features, leakage, scoring, split, training
from tabsight.operators.clean import sanitize, target_rows
from tabsight.operators.profile import column_facts
from tabsight.operators.roles import with_roles
from tabsight.plans import evidence, model_run, score_run
from tabsight.session import small_table


def planted(spark, n=400, seed=3, noise=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        plan, spend = rng.choice(["basic", "plus", "pro"]), rng.gauss(50, 10)
        score = (plan == "basic") * 2.0 + (50 - spend) / 10 + rng.gauss(0, 0.4)
        y = rng.randrange(2) if noise else int(score > 0.7)
        rows.append((1000 + i, plan, spend, str(rng.randrange(9)), y))
    return spark.createDataFrame(rows, "CustomerID long, plan string, spend double, visits string, target int")


@pytest.fixture(scope="module")
def fitted(spark):
    df = planted(spark).persist()
    config = training.TrainingConfig("target", ("CustomerID",), boosting_rounds=5)
    return df, model_run.run(df, config)


def test_planted_signal_beats_the_baseline(fitted):
    _, result = fitted
    m = result.model
    assert result.mode == "prediction" and m.verdict in ("strong", "useful")
    assert m.holdout["average_precision"] > m.baseline["average_precision"] + 0.15
    assert m.training_rows + m.holdout_rows == 400
    assert m.features.learned.identifiers == ["CustomerID"]
    assert {s.source: s.kind for s in m.features.learned.specs} == {"plan": "categorical", "spend": "numeric", "visits": "numeric"}
    assert result.cv.where("selected").count() == 3


def test_importance_finds_the_signal(fitted):
    rows = training.permutation_importance(fitted[1].model).collect()
    assert {rows[0]["feature"], rows[1]["feature"]} == {"plan", "spend"}
    assert rows[0]["importance"] > 0.05


def test_scoring_keeps_rows_and_names(spark, fitted):
    df, result = fitted
    refs = score_run.training_references(result.model)
    external = planted(spark, 120, seed=8).withColumn("CustomerID", F.col("CustomerID") + 5000)
    external = external.withColumn("prediction", F.lit("mine")).withColumn("probability_1", F.lit(9)).withColumn(
        "plan", F.when(F.col("CustomerID") % 10 == 0, "new plan").otherwise(F.col("plan"))
    )
    out = score_run.score(result.model, external, refs)
    assert out.prediction_column == "model_prediction"
    assert out.probability_columns["1"] == "model_probability_1"
    rows = out.scored.collect()
    assert len(rows) == 120 and {r["prediction"] for r in rows} == {"mine"}
    assert all(abs(r["probability_0"] + r["model_probability_1"] - 1) < 1e-9 for r in rows)
    assert out.evaluation.first()["evaluation_status"] == "completed"
    unseen = out.drift_categorical.where("column = 'plan'").first()["unseen_category_rate"]
    assert abs(unseen - 0.1) < 1e-9
    assert out.drift.first()["level"] in ("moderate", "high")
    assert out.overlap.agg(F.sum("overlap_rows")).first()[0] == 0
    long = evidence.evidence_long(result, out)
    assert {"decision", "validation", "drift", "readiness"} <= {r[0] for r in long.select("section").distinct().collect()}


def test_scoring_the_training_table_is_not_independent(fitted):
    df, result = fitted
    refs = score_run.training_references(result.model)
    out = score_run.score(result.model, df, refs)
    assert out.overlap.first()["overlap_rows"] == 400
    assert out.readiness.first()["status"] == "not deployment-ready"
    change = out.prevalence.first()
    assert change["training_rate"] == pytest.approx(result.model.baseline_strategy["positive_rate"])
    assert change["prevalence_change"] == pytest.approx(change["external_rate"] - change["training_rate"])


def test_self_drift_is_zero(fitted):
    _, result = fitted
    refs = score_run.training_references(result.model)
    out = score_run.score(result.model, result.model.train, refs)
    top = out.drift.first()
    assert top["level"] == "low" and top["max_smd"] < 1e-9 and top["max_total_variation"] < 1e-9


def test_missing_columns_and_unknown_labels(spark, fitted):
    df, result = fitted
    refs = score_run.training_references(result.model)
    with pytest.raises(ValueError, match="the table lacks.*spend"):
        score_run.score(result.model, df.drop("spend"), refs)
    blocked = score_run.score(result.model, df.withColumn("target", F.lit("maybe")), refs)
    assert blocked.evaluation.first()["reason"] == "labels not present in training"
    assert blocked.readiness.first()["status"] == "provisional"
    assert score_run.score(result.model, df.drop("target"), refs).evaluation.first()["evaluation_status"] == "not_requested"


def test_saved_model_scores_the_same(spark, fitted, tmp_path):
    df, result = fitted
    training.save_model(result.model, str(tmp_path / "m"))
    refs = score_run.training_references(result.model)
    score_run.save_references(refs, str(tmp_path / "r"))
    loaded = training.load_model(spark, str(tmp_path / "m"))
    again = score_run.load_references(spark, str(tmp_path / "r"))
    a = score_run.score(result.model, df, refs).scored.orderBy("CustomerID").collect()
    b = score_run.score(loaded, df, again).scored.orderBy("CustomerID").collect()
    assert a == b


def test_noise_is_called_weak(spark):
    config = training.TrainingConfig("target", ("CustomerID",), boosting_rounds=3)
    result = model_run.run(planted(spark, 300, noise=True), config, with_insights=False)
    assert result.model.verdict == "weak" and result.mode == "analysis"


def test_regression_run(spark):
    rng = random.Random(4)
    rows = [(i * 7, rng.gauss(0, 1), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "account_id long, measure double, region string").withColumn(
        "Revenue", F.col("measure") * 10 + F.when(F.col("region") == "a", 5.0).otherwise(0.0) + F.sin("account_id")
    )
    m = training.train_model(df, training.TrainingConfig("Revenue", ("account_id",), boosting_rounds=3))
    assert m.problem_type == "regression" and m.primary_metric == "rmse"
    assert m.holdout["rmse"] < m.baseline["rmse"] / 2 and m.verdict == "strong"


def test_config_is_checked():
    for bad in ({"target": ""}, {"effort": "huge"}, {"test_size": 0.5}, {"problem_type": "other"}):
        with pytest.raises(ValueError):
            training.TrainingConfig(**{"target": "t", "key": ("k",), **bad})


def test_every_feature_kind(spark):
    rows = []
    for i in range(240):
        rows.append((
            i * 3, None, "same", float(i % 17), str(i % 9), i % 2 == 0, f"2023-0{1 + i % 9}-11",
            "a, b" if i % 2 else "c", ", ".join([f"m{i % 100}", "z"]), f"{i % 30} kg", f"some rather long prose text number {i}",
            f"cat{i % 120}", "low" if i % 3 else "high", int(i % 5 == 0),
        ))
    schema = (
        "customer_id long, all_missing string, constant string, numeric double, numeric_text string, flag boolean, event_date string, "
        "multi_low string, multi_high string, weight string, prose string, many string, ordinary string, y int"
    )
    df = spark.createDataFrame(rows, schema)
    model = features.RawFeatures("y", "classification", "1", ["customer_id"]).fit(df)
    kinds = {s.source: (s.kind, s.frequency) for s in model.learned.specs}
    assert kinds == {
        "numeric": ("numeric", False), "numeric_text": ("numeric", False), "flag": ("categorical", False),
        "event_date": ("datetime", False), "multi_low": ("multi", False), "multi_high": ("multi", True),
        "weight": ("unit", False), "prose": ("words", False), "many": ("frequency", True), "ordinary": ("categorical", False),
    }
    assert dict(model.learned.dropped) == {"all_missing": "all values missing", "constant": "constant in training rows"}
    raw = model.raw(sanitize(df), ["customer_id"]).orderBy("customer_id").first()
    assert raw["event_date__dayofweek"] == 2.0 and raw["weight__number"] == 0.0 and raw["prose__word_count"] == 7.0
    assert raw["multi_low__item_count"] == 1.0 and raw["multi_low__first_item"] == "c"
    assert abs(raw["many__frequency"] - 2 / 240) < 1e-12
    unseen = model.raw(sanitize(df.withColumn("many", F.lit("never"))), ["customer_id"]).first()
    assert unseen["many__frequency"] == 0.0


def test_frequency_join_is_the_same_when_the_table_is_large(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 1500).cast("string"))).alias("v"))
    table = features.frequency_table(df, F.col("v"))
    one = sorted(map(tuple, features.frequency_code(df, F.col("v"), table, "f").collect()))
    monkeypatch.setattr(features, "BROADCAST_ROWS", 10)
    many = sorted(map(tuple, features.frequency_code(df, F.col("v"), table, "f").collect()))
    assert one == many and len(one) == 3000


def test_leakage_screen(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        y = rng.randrange(2)
        rows.append((1 - y, f"r{y}", y, rng.gauss(0, 1), float(y) + rng.random() * 0.5, y))
    df = spark.createDataFrame(rows, "inverse_label int, churn_reason string, copy int, ordinary_measure double, ChurnProbability double, churn int")
    r = with_roles(column_facts(sanitize(df)))
    found = {(x["column"], x["rule"], x["action"]) for x in leakage.screen(sanitize(df), r, "churn", "classification", "1").collect()}
    assert found == {
        ("copy", "target copy", "exclude"), ("churn_reason", "recorded after outcome", "exclude"),
        ("inverse_label", "near-perfect separator", "review"), ("inverse_label", "deterministic levels", "exclude"),
        ("ChurnProbability", "near-perfect separator", "exclude"),
    }


def test_splits_are_stable_and_complete(spark):
    df = spark.range(5000)
    a = split.holdout_split(df, ["id"])
    b = split.holdout_split(df.repartition(11), ["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    share = a.where("part = 'holdout'").count() / 5000
    assert 0.17 < share < 0.23
    folds = df.select(split.fold_column(["id"], 3).alias("f")).groupBy("f").count().collect()
    assert len(folds) == 3 and sum(r["count"] for r in folds) == 5000
    with pytest.raises(ValueError):
        split.fold_count(1, 100, "classification")


def test_stratified_sample_keeps_shares_and_rare_classes(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") == 7, "one").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    counts = {r["y"]: r["count"] for r in split.stratified_sample(df, "y", ["id"], 3000).groupBy("y").count().collect()}
    assert counts["one"] == 1 and abs(counts["a"] - 1000) <= 1 and abs(counts["b"] - 1999) <= 2


def test_drift_and_readiness_directions(spark):
    row = lambda i, e, b, rows=50, overlap=0: small_table(spark, [(i, e, b, rows, overlap, False)], "internal double, external double, baseline double, rows bigint, overlap bigint, blocked boolean")
    status = lambda *a, m="average_precision": scoring.readiness(row(*a), m).first()["status"]
    assert status(0.9, 0.88, 0.5) == "externally validated"
    assert status(0.9, 0.79, 0.5) == "not deployment-ready"
    assert status(0.9, 0.88, 0.5, 50, 3) == "not deployment-ready"
    assert status(0.9, 0.88, 0.5, 19) == "provisional"
    assert status(None, 0.88, 0.5) == "provisional"
    assert status(1.0, 1.05, 9.0, m="rmse") == "externally validated"
    assert status(1.0, 1.2, 9.0, m="rmse") == "not deployment-ready"


def test_output_names_never_replace_a_column():
    taken = {"prediction", "model_prediction"}
    assert scoring.output_name("prediction", taken) == "model_prediction_2"
    assert scoring.probability_name("Very High!") == "probability_very_high"


def test_double_targets_meet_whole_number_labels(spark):
    """A model of a 0.0/1.0 target is evaluated on 0/1 labels of any numeric type."""
    train = planted(spark, 300).withColumn("target", F.col("target").cast("double"))
    model = training.train_model(train, training.TrainingConfig("target", ("CustomerID",), boosting_rounds=3))
    assert model.labels == ["0", "1"]
    refs = score_run.training_references(model)
    for kind in ("bigint", "double"):
        external = planted(spark, 120, seed=8).withColumn("target", F.col("target").cast(kind))
        out = score_run.score(model, external, refs)
        assert out.evaluation.first()["evaluation_status"] == "completed"
        assert {r["metric"]: r["value"] for r in out.metrics.where("source = 'model'").collect()}["support"] == 120


def test_text_regression_targets_drop_what_is_no_number(spark):
    df = planted(spark, 200).withColumn(
        "amount", F.when(F.col("CustomerID") % 20 == 0, "n/a?").otherwise((F.col("spend") * 2).cast("string"))
    )
    config = training.TrainingConfig("amount", ("CustomerID",), "regression", boosting_rounds=3)
    m = training.train_model(df.drop("target"), config)
    assert m.training_rows + m.holdout_rows == 190


def test_rare_classes_are_in_every_part(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 15, "case").otherwise("control").alias("y"))
    parts = split.stratified_holdout(df, ["id"], "y")
    counts = {(r["y"], r["part"]): r["count"] for r in parts.groupBy("y", "part").count().collect()}
    assert counts == {("case", "holdout"): 3, ("case", "train"): 12, ("control", "holdout"): 57, ("control", "train"): 228}
    folds = split.stratified_folds(df, ["id"], "y", 3)
    counts = {(r["y"], r["_fold"]): r["count"] for r in folds.groupBy("y", "_fold").count().collect()}
    assert counts == {(y, k): n // 3 for y, n in (("case", 15), ("control", 285)) for k in range(3)}


def test_targets_with_too_many_classes_are_refused(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), "id").alias("y"), F.rand(1).alias("x"))
    with pytest.raises(ValueError, match="more than 1000 values"):
        training.train_model(df, training.TrainingConfig("y", ("id",), "classification"))


def test_one_outlying_order_key_changes_no_block(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ORDER_BLOCK_ROWS", 50)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(1000).select(
        F.when(F.col("id") == 999, 10**15).otherwise(F.col("id")).alias("k"),
        (start + F.make_dt_interval(F.col("id"))).alias("up"),
        (start + F.make_dt_interval((F.col("id") * 7) % 1000)).alias("mixed"),
    )
    got = {r["column"]: (r["paired"], r["flagged"]) for r in leakage.time_order(df, ["up", "mixed"], ["k"]).collect()}
    assert got == {"up": (1000, True), "mixed": (1000, False)}


def test_values_hot_only_when_scoring_meet_their_share(spark, monkeypatch):
    monkeypatch.setattr(features, "BROADCAST_ROWS", 3)
    train = spark.range(5000).select(F.concat(F.lit("v"), (F.col("id") % 2500).cast("string")).alias("c"))
    table = features.frequency_table(train, F.col("c"))
    scored = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "v7").when(F.col("id") % 3 == 0, "new").otherwise("v8").alias("c"))
    got = {r["c"]: (r["f"], r["n"]) for r in features.frequency_code(scored, F.col("c"), table, "f").groupBy("c", "f").agg(F.count("*").alias("n")).collect()}
    assert {k: round(v[0], 6) for k, v in got.items()} == {"v7": 0.0004, "v8": 0.0004, "new": 0.0}
    assert sum(v[1] for v in got.values()) == 2000


def test_best_round_waits_out_the_patience():
    assert training.best_round([]) == (0, False)
    falling = [1.0 / i for i in range(1, 31)]
    assert training.best_round(falling) == (30, False)
    assert training.best_round([0.9, 0.5, 0.6, 0.4, *[0.45] * 9]) == (4, False)
    assert training.best_round([0.9, 0.5, 0.6, 0.4, *[0.45] * 10, 0.1]) == (4, True)
    assert training.best_round([0.5, 0.5 - 1e-9, *[0.5] * 10]) == (1, True)


def test_three_classes_are_boosted(spark, monkeypatch):
    """One model a class against the rest; shares add up to one, and a class that no line separates is found."""
    df = spark.range(900).select("id", (F.col("id") * 37 % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("noise"))
    df = df.withColumn("band", F.when(F.col("x").between(30, 60), "mid").when(F.col("x") % 2 == 0, "even").otherwise("odd"))
    df = df.withColumn("parity", (F.col("x") % 2).cast("double"))
    model = training.train_model(df, training.TrainingConfig("band", ("id",), boosting_rounds=6))
    assert model.name == "Gradient Boosting" and len(model.rounds) == 3 and all(1 <= n <= 6 for n in model.rounds)
    assert model.holdout["f1_macro"] > 0.95
    assert model.feature_names() == model.features.numeric_outputs()
    rows = model.predict(df, ["id", "band"]).limit(50).collect()
    assert all(abs(r["_p0"] + r["_p1"] + r["_p2"] - 1) < 1e-9 for r in rows)
    assert {(r["model"], r["fold"]): len(r["rounds"]) for r in training.cv_table(spark, model).collect()}[("Gradient Boosting", 0)] == 3


def test_input_names_match_the_coefficients(spark):
    """One-hot inputs name their level; as many names as ridge coefficients."""
    df = spark.range(400).select("id", (F.col("id") % 11).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a b").otherwise("c").alias("kind"))
    df = df.withColumn("y", F.col("x") * 2.0 + F.when(F.col("kind") == "c", 1.5).otherwise(0.0) + F.rand(seed=1) * 0.01)
    model = training.train_model(df, training.TrainingConfig("y", ("id",), "regression", boosting_rounds=2))
    assert model.name == "Ridge Regression"
    names = model.feature_names()
    assert names == ["x", "kind=a b", "kind=c"] and len(names) == len(model.model.stages[-1].coefficients)


def _prepared(spark, n):
    """Rows as the features leave them: two inputs of few values and one of 1,000."""
    k = F.col("id")
    rows = spark.range(n).select(
        (k % 3).cast("double").alias("num:a"), (k * 7919 % 5).cast("double").alias("num:b"), (k * 37 % 1000 / 10.0).alias("num:x"),
        (F.pmod(F.xxhash64(k), F.lit(10)) == 0).alias("_late"), (F.pmod(F.xxhash64(k, F.lit(1)), F.lit(100)) / 100.0).alias("u"),
    )
    return rows.withColumn("v", F.col("num:a") * 2 + F.col("num:b") + (F.col("num:x") > 40).cast("double") + F.col("u"))


def _fit(monkeypatch, booster, prepared, names, rounds):
    seen = []
    plain = type(booster).fit

    def watched(self, frame, params=None):
        seen.append(frame)
        return plain(self, frame, params)

    monkeypatch.setattr(type(booster), "fit", watched)
    learned = features.Learned(specs=[features.Spec(n, "numeric", [n], [True]) for n in names])
    model, reached = training.fit_candidate(features.RawFeaturesModel(learned, {}), "ordinal", [booster], prepared, rounds)
    return model, reached, seen


def test_boosted_regression_reads_cells(spark, monkeypatch):
    """Its many passes follow the number of cells, every row counts, and the model is that of the rows."""
    prepared = _prepared(spark, 24_000).withColumn("_y", F.col("v")).persist()
    booster = training.GBTRegressor(labelCol="_y", featuresCol="_x", maxIter=4, maxDepth=4, stepSize=0.3, seed=42)
    model, _, (frame,) = _fit(monkeypatch, booster, prepared, ["a", "b"], [4])
    assert frame.count() == 30 and frame.agg(F.sum("_n")).first()[0] == 24_000
    rows = training.VectorAssembler(inputCols=["num:a", "num:b"], outputCol="_x").transform(prepared)
    by_rows = {(r["num:a"], r["num:b"]): r["prediction"] for r in booster.fit(rows).transform(rows).select("num:a", "num:b", "prediction").distinct().collect()}
    by_cells = {(r["num:a"], r["num:b"]): r["prediction"] for r in model.transform(prepared).select("num:a", "num:b", "prediction").distinct().collect()}
    assert len(by_rows) == 15 and by_cells == pytest.approx(by_rows, rel=1e-9)
    wide, _, (frame,) = _fit(monkeypatch, booster, prepared, ["a", "b", "x"], [4])
    assert frame.count() <= 3 * 5 * training.BINS * 2 and frame.agg(F.sum("_n")).first()[0] == 24_000
    rmse = wide.transform(prepared).agg(F.sqrt(F.avg((F.col("prediction") - F.col("v")) ** 2))).first()[0]
    assert rmse < model.transform(prepared).agg(F.sqrt(F.avg((F.col("prediction") - F.col("v")) ** 2))).first()[0] - 0.05


def test_boosted_classes_are_judged_by_weight(spark, monkeypatch):
    """Rounds are chosen on the set-aside rows: the losses of their cells are those of the rows."""
    prepared = _prepared(spark, 24_000).withColumn("_y", (F.col("v") > 5).cast("double")).persist()
    booster = training.GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=6, maxDepth=4, stepSize=0.3, seed=42)
    model, reached, seen = _fit(monkeypatch, booster, prepared, ["a", "b", "x"], None)
    assert 1 <= reached[0] <= 6 and all(f.count() <= 3 * 5 * training.BINS * 4 for f in seen)
    last, rows = model.stages[-1], prepared.where("_late").withColumn("_n", F.lit(1.0))
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    cells = seen[-1].where("_late")
    assert cells.count() < rows.count()
    assert last.evaluateEachIteration(cells) == pytest.approx(last.evaluateEachIteration(rows), rel=1e-9)


def test_few_rows_are_boosted_as_they_are(spark, monkeypatch):
    prepared = _prepared(spark, 600).withColumn("_y", F.col("v")).persist()
    booster = training.GBTRegressor(labelCol="_y", featuresCol="_x", maxIter=2, maxDepth=4, seed=42)
    _, _, (frame,) = _fit(monkeypatch, booster, prepared, ["a", "b", "x"], [2])
    assert frame.count() == 600 and "_n" not in frame.columns


def test_bin_edges_leave_heavy_values_their_own_bin(spark):
    k = F.col("id")
    df = spark.range(20_000).select(
        F.when(k % 10 < 9, 0.0).otherwise(k / 100.0 - 100).alias("num:a.b"), (k % 32).cast("double").alias("few"), k.cast("double").alias("even"),
    )
    edges = training.bin_edges(df, ["num:a.b", "few", "even"])
    assert set(edges) == {"num:a.b", "even"} and all(len(e) < training.BINS for e in edges.values())
    binned = df.select(F.expr(training._bin_sql("`num:a.b`", edges["num:a.b"])).alias("b"), (F.col("`num:a.b`") == 0).alias("zero"))
    sizes = {(r["b"], r["zero"]): r["count"] for r in binned.groupBy("b", "zero").count().collect()}
    zero = [b for b, z in sizes if z]
    assert len(zero) == 1 and (zero[0], False) not in sizes
    assert len(sizes) >= 28 and max(n for (_, z), n in sizes.items() if not z) < 200
    shares = [r["count"] for r in df.groupBy(F.expr(training._bin_sql("even", edges["even"]))).count().collect()]
    assert len(shares) == 32 and max(shares) < 20_000 / 32 + 60


def test_training_rows_of_one_partition_are_spread(spark):
    """Missing and repeated keys are no reason to stay together; a small table stays as it is."""
    df = spark.range(300_000).coalesce(1).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"), F.rand(1).alias("x"))
    sizes = [r["count"] for r in training._spread(df).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 200_000 and sum(sizes) == 300_000
    few = df.limit(500)
    assert training._spread(few) is few


def test_repeated_cleaning_stays_short(spark):
    """A target cleaned five times, as training does, is not a condition of hundreds of terms."""
    rows = spark.range(8).select(F.expr("element_at(array(1.5D, double('nan'), double('infinity'), double('-infinity'), -0.0D, null, 7.0D, -2.5D), int(id) + 1)").alias("x"))
    for _ in range(5):
        rows = target_rows(rows, "x")
    assert sorted(r["x"] for r in rows.collect()) == [-2.5, 0.0, 1.5, 7.0]
    plan = rows.select("x")._jdf.queryExecution().analyzed().toString()
    assert "isnan" not in plan
