import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsight.functions.stats import adjust_p
from tabsight.operators import leakage, metrics
from tabsight.operators.ordered import exact_quantiles, median_and_mad, running_totals


def test_quantiles_equal_numpy_with_and_without_ranges(spark):
    rng = random.Random(1)
    # A third of all rows carry one value.
    xs = [5.0] * 400 + [round(rng.gauss(0, 10), 3) for _ in range(800)]
    ys = [float(i % 7) if i % 5 else None for i in range(1200)]
    rng.shuffle(xs)
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    fractions = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    for limit in (1_000_000, 60):
        got = exact_quantiles(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None).cast("double")}, fractions, limit)
        assert np.allclose(got["x"], np.quantile(xs, fractions))
        assert np.allclose(got["y"], np.quantile([y for y in ys if y is not None], fractions))
        assert got["none"] == [None] * 6


def test_running_totals_do_not_depend_on_ranges(spark):
    rng = random.Random(2)
    rows = [(g, float(k), rng.randrange(1, 9)) for g in "ab" for k in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, k double, n long").repartition(5)
    for descending in (False, True):
        one = running_totals(df, "k", ["n"], ["g"], descending).collect()
        many = running_totals(df, "k", ["n"], ["g"], descending, values_per_task=37).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_precision_match_brute_force(spark):
    rng = random.Random(5)
    pairs = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "score double, y int")
    got = metrics.ranking_metrics(df, "y", "score", "1").first()
    assert abs(got["roc_auc"] - brute_auc(pairs)) < 1e-12
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        here = [y for x, y in pairs if x == s]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) * tp / seen
    assert abs(got["average_precision"] - ap / sum(y for _, y in pairs)) < 1e-12
    flipped = metrics.ranking_metrics(df.withColumn("score", -F.col("score")), "y", "score", "1").first()
    assert abs(flipped["roc_auc"] + got["roc_auc"] - 1) < 1e-12
    leak = leakage.separator_auc(df, "y", "1", ["score"]).first()
    assert abs(leak["auc"] - brute_auc(pairs)) < 1e-12


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=25))
def test_adjusted_p_is_monotone_and_bounded(spark, ps):
    rows = adjust_p(spark.createDataFrame([(p,) for p in ps], "p_value double")).orderBy("p_value").collect()
    adjusted = [r["adjusted_p_value"] for r in rows]
    assert all(a <= b + 1e-15 for a, b in zip(adjusted, adjusted[1:]))
    assert all(r["p_value"] - 1e-15 <= r["adjusted_p_value"] <= 1 for r in rows)


def test_time_order_sees_breaks_across_blocks(spark):
    up = spark.range(2000).select("id", F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts")).repartition(6)
    assert leakage.time_order(up, ["ts"], ["id"]).first()["flagged"]
    broken = up.withColumn("ts", F.when(F.col("id") == 1500, F.lit("1960-01-01").cast("timestamp_ntz")).otherwise(F.col("ts")))
    assert not leakage.time_order(broken, ["ts"], ["id"]).first()["flagged"]
    assert leakage.time_order(up, ["ts"], None).count() == 0


def test_adjusted_p_of_many_rows_is_the_step_up_at_any_size(spark):
    """One row looks at each later row no more than once; ranges, ties and missing values change nothing."""
    import time

    rng = random.Random(5)
    ps = [0.0] * 30 + [1.0] * 40 + [round(rng.random() ** 3, 3) for _ in range(400)]
    want, low = {}, 1.0
    for rank, p in sorted(enumerate(sorted(ps), 1), reverse=True):
        low = min(low, p * len(ps) / rank)
        want[p] = low
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double").repartition(5)
    for limit in (1_000_000, 50, 7):
        got = adjust_p(df, values_per_task=limit)
        assert got.columns == ["i", "p_value", "adjusted_p_value"]
        assert sorted(r.i for r in got.collect()) == list(range(len(ps)))
        assert all(abs(r.adjusted_p_value - want[r.p_value]) < 1e-12 for r in got.collect())
    gaps = df.select(F.when(F.col("i") % 10 > 0, F.col("p_value")).alias("p_value"), "i")
    assert sorted(map(str, adjust_p(gaps).collect())) == sorted(map(str, adjust_p(gaps, values_per_task=50).collect()))
    # Quadratic frames took minutes here.
    start = time.monotonic()
    many = spark.range(100_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("p_value"))
    assert adjust_p(many).where("adjusted_p_value BETWEEN 0 AND 1").count() == 100_000
    assert time.monotonic() - start < 60


def test_ranges_without_a_wanted_rank_are_left_out(spark):
    df = spark.range(1000).select(F.lit("q0").alias("name"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    holds = (F.col("_o_n") <= 500) & (F.col("_o_n") + F.col("_t_n") > 500)
    rows = running_totals(df, "x", ["n"], ["name"], values_per_task=100, needed=holds).collect()
    assert len(rows) < 400 and [r.cum_n for r in rows if r.x == 500.0] == [501]


def test_median_and_mad_come_from_one_grouping(spark):
    rng = random.Random(8)
    xs = [round(rng.gauss(3, 2), 2) for _ in range(500)]
    df = spark.createDataFrame([(x, x if i % 4 else None) for i, x in enumerate(xs)], "x double, y double")
    for limit in (1_000_000, 40):
        got = median_and_mad(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None).cast("double")}, limit)
        for name, values in (("x", xs), ("y", [x for i, x in enumerate(xs) if i % 4])):
            middle = np.median(values)
            assert np.allclose(got[name], (middle, np.median(np.abs(np.array(values) - middle))))
        assert got["none"] == (None, None)
