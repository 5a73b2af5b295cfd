"""Deterministic samples, holdout and folds from a salted key hash, plain or stratified by class.

A row's place depends only on its key and the seed: no shuffle is needed, the split
survives recomputation, and every engine that knows MD5 gets the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def key_hash(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("#", *[col(k).cast("string") for k in key], F.lit(str(seed))))


def holdout_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``part``: holdout where the first hash digits fall below the share."""
    if not 0.1 <= test_size <= 0.4:
        raise ValueError("test_size must be between 0.1 and 0.4.")
    bound = f"{int(test_size * 16**8):08x}"
    return df.withColumn(
        "part", F.when(F.substring(key_hash(key, seed), 1, 8) < bound, "holdout").otherwise("train")
    )


def fold_column(key: list[str], folds: int, seed: int = 42) -> Column:
    """Fold number from a hash slice the holdout does not use."""
    slice_ = F.conv(F.substring(key_hash(key, seed), 9, 8), 16, 10).cast("bigint")
    return (slice_ % folds).cast("int")


def class_cuts(df: DataFrame, target: str, hashed: Column, shares: list[float]) -> dict[str | None, list[str]]:
    """For each class the hashes that cut off the given shares of its rows, exactly.

    The class counts give the quotas.  Hashes are uniform, so a cut lies within a few standard
    deviations of its share: rows below that band are only counted and rows in it are ranked, a share
    of a class that shrinks as the class grows.
    """
    spark = df.sparkSession
    rows = df.select(col(target).cast("string").alias("label"), hashed.alias("h"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    edge = lambda x: "" if x <= 0 else "g" if x >= 1 else f"{int(x * 16**12):012x}"
    bounds = []
    for label, n in counts:
        for i, share in enumerate(shares):
            spread = 8 * (share * (1 - share) / n) ** 0.5 + 8 / n
            bounds.append((label, i, int(n * share + 0.5), edge(share - spread), edge(share + spread)))
    table = spark.createDataFrame(bounds, "name string, cut int, quota bigint, low string, high string")
    near = rows.join(F.broadcast(table), F.col("label").eqNullSafe(F.col("name"))).where(F.col("h") < F.col("high"))
    below = near.groupBy("name", "cut").agg(F.count_if(F.col("h") < F.col("low")).alias("below"))
    rank = F.row_number().over(Window.partitionBy("name", "cut").orderBy("h"))
    band = near.where(F.col("h") >= F.col("low")).select("name", "cut", "quota", "h", rank.alias("r"))
    same = F.col("name").eqNullSafe(F.col("b_name")) & (F.col("cut") == F.col("b_cut"))
    placed = band.join(below.withColumnsRenamed({"name": "b_name", "cut": "b_cut"}), same).where(F.col("r") + F.col("below") <= F.col("quota"))
    found = {(r.name, r.cut): r.h for r in placed.groupBy("name", "cut").agg(F.max("h").alias("h")).collect()}
    return {label: [found.get((label, i), "") for i in range(len(shares))] for label, _ in counts}


def _parts_passed(target: str, hashed: Column, cuts: dict[str | None, list[str]]) -> Column:
    """How many of its class's cuts a row's hash lies beyond."""
    label, out = col(target).cast("string"), F.lit(0)
    for name, hashes in cuts.items():
        hit = label.isNull() if name is None else label == name
        out = F.when(hit, sum(((hashed > h).cast("int") for h in hashes), F.lit(0))).otherwise(out)
    return out


def stratified_holdout(df: DataFrame, key: list[str], target: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``part``: of each class exactly the rounded share with the smallest hashes is held out."""
    if not 0.1 <= test_size <= 0.4:
        raise ValueError("test_size must be between 0.1 and 0.4.")
    hashed = key_hash(key, seed)
    inside = _parts_passed(target, hashed, class_cuts(df, target, hashed, [test_size])) == 0
    return df.withColumn("part", F.when(inside, "holdout").otherwise("train"))


def stratified_folds(df: DataFrame, key: list[str], target: str, folds: int, seed: int = 42) -> DataFrame:
    """Column ``_fold``: each class is dealt to folds of equal size, give or take a row."""
    hashed = F.md5(F.concat(key_hash(key, seed), F.lit("#fold")))
    cuts = class_cuts(df, target, hashed, [i / folds for i in range(1, folds)])
    return df.withColumn("_fold", _parts_passed(target, hashed, cuts))


def fold_count(rarest: int, rows: int, problem_type: str, effort: str = "standard") -> int:
    requested = 3 if effort == "standard" else 5
    if problem_type == "regression":
        return min(requested, max(2, rows // 10))
    folds = min(requested, rarest)
    if folds < 2:
        raise ValueError(f"the rarest class has {rarest} training row(s); folds need 2")
    return folds


def stratified_sample(df: DataFrame, target: str, key: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows with class shares kept; every class keeps a row.

    Class quotas come from the class counts.  Each class takes its smallest key hashes:
    a first cut on the hash leaves about the quota of every class, so the ranking that
    makes the count exact only ever sees a little more than the sample itself.
    """
    counts = df.groupBy(col(target).cast("string").alias("_label")).agg(F.count(F.lit(1)).alias("_n")).collect()
    total = sum(r["_n"] for r in counts)
    if total <= max_rows:
        return df
    quotas, cuts = [], []
    for r in sorted(counts, key=lambda r: (-r["_n"], str(r["_label"]))):
        quota = max(1, int(max_rows * r["_n"] / total))
        quotas.append((r["_label"], quota))
        share = min(1.0, (quota + 6 * quota**0.5 + 20) / r["_n"])
        cuts.append((r["_label"], share))
    label = col(target).cast("string")
    bound, quota_of = F.lit("g"), F.lit(0)
    for (name, share), (_, quota) in zip(cuts, quotas, strict=True):
        hit = label.isNull() if name is None else label == name
        top = "g" if share >= 1.0 else f"{int(share * 16**8):08x}"
        bound, quota_of = F.when(hit, top).otherwise(bound), F.when(hit, quota).otherwise(quota_of)
    hashed = df.withColumn("_h", key_hash(key, seed)).where(F.substring("_h", 1, 8) < bound)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", *[col(k) for k in key]))
    return hashed.withColumn("_q", quota_of).withColumn("_r", rank).where(F.col("_r") <= F.col("_q")).drop("_h", "_q", "_r")
