"""The saved profile: batches merge to the profile of the whole table."""

import pytest
from pyspark.sql import functions as F

from tabsight.operators import ordered, profile
from tabsight.operators.clean import sanitize
from tabsight.operators.profile_store import ProfileStore


@pytest.fixture
def store(spark, tmp_path):
    return ProfileStore(spark, str(tmp_path / "store"))


def rows(spark, low, high):
    long = "a text of many words beyond the thirty two bytes of a digest "
    return spark.range(low, high).select(
        F.col("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 7 / 2).alias("x"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(long), F.col("id") % 4)).when(F.col("id") % 3 == 1, "12").otherwise(" N/A ").alias("s"),
        (F.col("id") % 2 == 0).alias("b"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("d"),
    )


def facts(df):
    return sorted(map(tuple, df.collect()))


def test_merged_batches_equal_the_whole_table(spark, store):
    parts = [rows(spark, 0, 40), rows(spark, 40, 90), rows(spark, 80, 120)]
    whole = sanitize(parts[0].union(parts[1]).union(parts[2]))
    for part in parts:
        store.add(part.repartition(3))
    assert facts(store.facts()) == facts(profile.column_facts(whole))
    assert store.duplicate_rows().first() == profile.duplicate_rows(whole).first()
    assert store.duplicate_rows().first()[0] == 10
    assert store.fingerprint().first() == profile.fingerprint(whole).first()
    want = ordered.exact_quantiles(whole, {c: F.col(c).cast("double") for c in ("id", "x")}, [0.1, 0.5, 1.0])
    got = store.quantiles([0.1, 0.5, 1.0]).collect()
    assert {c: [r.value for r in got if r.column == c] for c in want} == want
    assert store.overview().first() == profile.overview(whole, profile.column_facts(whole)).first()


def test_a_batch_counts_once_and_keeps_its_columns(spark, store):
    first = store.add(rows(spark, 0, 30))
    assert store.add(rows(spark, 0, 30).repartition(4)) == first and store.batches().count() == 1
    with pytest.raises(ValueError, match="the store holds"):
        store.add(rows(spark, 0, 5).drop("x"))
    store.add(rows(spark, 0, 0))
    assert store.facts().first().rows == 30 and store.batches().count() == 2


def test_what_a_lost_driver_left_is_not_read(spark, store):
    store.add(rows(spark, 0, 10))
    half = profile.column_groups(sanitize(rows(spark, 10, 20)), sanitize(rows(spark, 10, 20)).schema["id"])
    half.write.parquet(f"{store.path}/values/c0/batch=unlisted")
    assert store.facts().first().rows == 10 and store.groups("id").count() == 10


def test_an_empty_store_raises(store):
    assert store.batches().count() == 0
    with pytest.raises(ValueError, match="no profile"):
        store.facts()


def test_fingerprints_tell_cells_apart(spark):
    """Neither a missing cell nor a separator inside one gives the digest of another row."""
    seen = [
        profile.fingerprint(spark.createDataFrame([row], "a string, b string")).first()[0]
        for row in [("1:x", "y"), ("1", ":xy"), (None, "-"), ("-", None), ("", None), (None, ""), ("x", "y"), ("y", "x")]
    ]
    assert len(set(seen)) == len(seen)


def test_fingerprint_sums_are_those_of_the_digests(spark):
    """Lanes are added as whole numbers; the sums are the four parts of each row's MD5."""
    import hashlib

    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"v{i}") for i in range(50)], "k long, s string")
    want = [0, 0, 0, 0]
    for r in df.collect():
        text = "".join("-" if x is None else f"{len(str(x))}:{x}" for x in r)
        digest = hashlib.md5(text.encode()).hexdigest()
        want = [w + int(digest[8 * i : 8 * i + 8], 16) for i, w in enumerate(want)]
    sums = profile.fingerprint_sums(df)
    assert [int(x) for x in sums.first()] == [50, *want] and set(dict(sums.dtypes[1:]).values()) == {"decimal(38,0)"}
    assert [int(x) for x in profile.fingerprint_sums(df.limit(0)).first()] == [0] * 5
