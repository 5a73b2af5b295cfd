"""Exact column profile.

``column_facts`` measures every column with plans that only ever read the columns
they need:

* one ``GROUP BY value`` per column, in the column's own type, that yields every fact of
  that column.  A hot value collapses in the map-side partial aggregate, parsing runs
  once per distinct value, and long text travels as a digest;
* a sort-free count of unit gaps, only for the columns where it can matter.

Each of these ends in one row per column, which is the only thing the driver sees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import col, datetime_sql, digest_sql, literal, number_sql, ref, safe_ratio, words_sql
from ..session import beside, small_table
from .clean import family

COLUMNS_PER_JOB = 48

FACT_SCHEMA = (
    "position int, column string, dtype string, family string, rows bigint, non_null bigint, "
    "distinct bigint, min_count bigint, numeric_ok bigint, date_ok bigint, words bigint, "
    "chars bigint, integer_like boolean, min_value double, max_value double, "
    "unit_gaps bigint, close_gaps bigint"
)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def integer_like_sql(x: str) -> str:
    """Close to a whole number: absolute 1e-9 plus relative 1e-5."""
    return f"(abs({x} - rint({x})) <= 1e-9D + 1e-5D * abs(rint({x})))"


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def column_groups(df: DataFrame, f: T.StructField) -> DataFrame:
    """``k, n`` and what must be measured row by row, one row for each distinct value of a column.

    Text is grouped by itself or, above 32 bytes, by its digest, which no longer holds the text: words, length,
    number and date of such rows are summed up beside.  ``merged_groups`` adds the groups of further rows.
    """
    x = ref(f.name)
    if not _is_text(f):
        return df.selectExpr(f"{x} AS k").groupBy("k").agg(F.expr("count(1) AS n"))
    long_text = f"octet_length({x}) > 32"
    return (
        df.selectExpr(
            f"{digest_sql(x)} AS k",
            f"CASE WHEN {long_text} THEN {words_sql(x)} END AS w",
            f"CASE WHEN {long_text} THEN length({x}) END AS l",
            f"CASE WHEN {long_text} THEN {number_sql(x)} END AS x",
            f"CASE WHEN {long_text} THEN {datetime_sql(x)} END AS t",
        )
        .groupBy("k")
        .agg(
            F.expr("count(1) AS n"), F.expr("sum(w) AS w"), F.expr("sum(l) AS l"),
            F.expr("count(x) AS xn"), F.expr("count(t) AS tn"),
            F.expr(f"bool_and({integer_like_sql('x')}) AS xi"),
            F.expr("min(x) AS xlow"), F.expr("max(x) AS xhigh"),
        )
    )


def merged_groups(groups: DataFrame, f: T.StructField) -> DataFrame:
    """The groups of all rows from the groups of their parts."""
    text = ["sum(w) AS w", "sum(l) AS l", "sum(xn) AS xn", "sum(tn) AS tn", "bool_and(xi) AS xi", "min(xlow) AS xlow", "max(xhigh) AS xhigh"]
    return groups.groupBy("k").agg(*[F.expr(e) for e in ["sum(n) AS n", *(text if _is_text(f) else [])]])


def group_facts(groups: DataFrame, position: int, f: T.StructField) -> DataFrame:
    """All facts of one column from its groups, each value measured once and weighted by its count."""
    kind = family(f.dataType)
    if _is_text(f):
        groups = groups.selectExpr(
            "*",
            f"CASE WHEN w IS NULL THEN {number_sql('k')} END AS num",
            f"CASE WHEN w IS NULL THEN {datetime_sql('k')} END AS day",
        )
        numbers = "coalesce(sum(CASE WHEN num IS NOT NULL THEN n ELSE xn END), 0)"
        measures = [
            f"{numbers} AS numeric_ok",
            "coalesce(sum(CASE WHEN day IS NOT NULL THEN n ELSE tn END), 0) AS date_ok",
            f"coalesce(sum(CASE WHEN k IS NOT NULL THEN coalesce(w, n * {words_sql('k')}) END), 0) AS words",
            "coalesce(sum(CASE WHEN k IS NOT NULL THEN coalesce(l, n * length(k)) END), 0) AS chars",
            f"coalesce(bool_and(coalesce({integer_like_sql('num')}, xi)) AND {numbers} = sum(CASE WHEN k IS NOT NULL THEN n END), false) AS integer_like",
            "min(coalesce(num, xlow)) AS min_value",
            "max(coalesce(num, xhigh)) AS max_value",
        ]
    else:
        number = kind == "numeric"
        measures = [
            *[f"CAST(NULL AS BIGINT) AS {m}" for m in ("numeric_ok", "date_ok", "words", "chars")],
            f"coalesce(bool_and({integer_like_sql('double(k)')}), false) AS integer_like" if number else f"{str(kind == 'boolean').lower()} AS integer_like",
            "min(double(k)) AS min_value" if number else "CAST(NULL AS DOUBLE) AS min_value",
            "max(double(k)) AS max_value" if number else "CAST(NULL AS DOUBLE) AS max_value",
        ]
    counts = [
        "coalesce(sum(n), 0) AS rows",
        "coalesce(sum(CASE WHEN k IS NOT NULL THEN n END), 0) AS non_null",
        "count(k) AS distinct",
        "coalesce(min(CASE WHEN k IS NOT NULL THEN n END), 0) AS min_count",
    ]
    return groups.agg(*[F.expr(e) for e in counts + measures]).selectExpr(
        f"{position} AS position", f"{literal(f.name)} AS column",
        f"{literal(f.dataType.simpleString())} AS dtype", f"{literal(kind)} AS family", "*",
    )


def grouped_facts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row of facts per column; a lazy union of column-pruned groupings."""
    wanted = set(names or df.columns)
    return union_all(
        [group_facts(column_groups(df, f), i, f) for i, f in enumerate(df.schema.fields) if f.name in wanted]
    )


def value_counts(df: DataFrame, name: str, keyed: bool = False) -> DataFrame:
    """``(value, n)`` of the non-missing values of one column, in the column's own type."""
    value = ref(name)
    if keyed and isinstance(df.schema[name].dataType, T.StringType):
        value = digest_sql(value)
    return (
        df.selectExpr(f"{value} AS value")
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_frequency(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` over all columns; missing values are counted as null.

    One grouped, column-pruned branch per column instead of exploding every row into
    one row per cell: no row fan-out, keys stay typed until they are grouped.
    """
    parts = [
        df.groupBy(col(name).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("column"), F.col("v").cast("string").alias("value"), "n")
        for name in (names or df.columns)
    ]
    return union_all(parts)


def top_values(df: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """The k most frequent values per column, ties by value.

    Counting runs on digests of long text; only the k winners per column fetch their
    text back.  The ranking keeps k rows per task before its shuffle.
    """
    parts = []
    for name in names:
        dtype = df.schema[name].dataType
        counted = value_counts(df, name, keyed=True).select(
            F.lit(name).alias("column"), F.col("value").cast("string").alias("key"), "n"
        )
        parts.append((counted, isinstance(dtype, T.StringType)))
    ranked = union_all([p for p, _ in parts])
    order = Window.partitionBy("column").orderBy(F.desc("n"), "key")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best


def resolve_text(df: DataFrame, best: DataFrame, names: list[str]) -> DataFrame:
    """Replace digests of long text in ``best`` (few rows) by the text itself."""
    spark = df.sparkSession
    winners = best.collect()  # k rows per column
    long_keys: dict[str, list[str]] = {}
    for row in winners:
        if row["key"] is not None and len(row["key"]) == 32:
            long_keys.setdefault(row["column"], []).append(row["key"])
    texts: dict[tuple[str, str], str] = {}
    lookups = [
        df.where(F.expr(digest_sql(ref(name))).isin(*keys))
        .groupBy(F.expr(digest_sql(ref(name))).alias("key"))
        .agg(F.min(col(name)).alias("text"))
        .select(F.lit(name).alias("column"), "key", "text")
        for name, keys in long_keys.items()
        if isinstance(df.schema[name].dataType, T.StringType)
    ]
    if lookups:
        for row in union_all(lookups).collect():
            texts[row["column"], row["key"]] = row["text"]
    return small_table(
        spark,
        [
            (r["column"], texts.get((r["column"], r["key"]), r["key"]), r["n"], r["rank"])
            for r in winners
        ],
        "column string, value string, n bigint, rank int",
    )


def gap_facts(df: DataFrame, integral: dict[str, bool]) -> DataFrame:
    """How many neighbouring sorted values differ by one, without sorting.

    Each value meets its possible successors in a grouping by cell.  Whole numbers use
    the number itself as cell and look one ahead.  Other numbers use half-unit cells: two
    neighbours that differ by one lie one to three cells apart.  Both groupings are spread
    by value and pre-aggregated; no column has to fit in one task.
    """
    parts = []
    for name, whole in integral.items():
        cell = "rint(x)" if whole else "floor(x * 2)"
        steps = (1,) if whole else (1, 2, 3)
        ahead = ", ".join(f"named_struct('cell', cell - {s}, 'step', {s}, 'x', low)" for s in steps)
        pairs = (
            df.selectExpr(f"double({ref(name)}) AS x")
            .where("x IS NOT NULL")
            .groupBy(F.expr(f"{cell} AS cell"))
            .agg(F.expr("min(x) AS low"), F.expr("max(x) AS high"))
            .selectExpr(f"inline(array(named_struct('cell', cell, 'step', 0, 'x', high), {ahead}))")
            .groupBy("cell")
            .agg(
                F.expr("max(CASE WHEN step = 0 THEN x END) AS here"),
                F.expr("min(CASE WHEN step > 0 THEN x END) AS next"),
            )
        )
        parts.append(
            pairs.agg(
                F.expr("count_if(next - here = 1) AS unit_gaps"),
                F.expr("count_if(abs(next - here - 1) <= 1e-8D + 1e-5D) AS close_gaps"),
            ).selectExpr(f"{literal(name)} AS column", "unit_gaps", "close_gaps")
        )
    return union_all(parts)


def column_facts(df: DataFrame) -> DataFrame:
    """All measurements of a sanitized table as a small table, one row per column."""
    measured = []
    for start in range(0, len(df.columns), COLUMNS_PER_JOB):
        measured += grouped_facts(df, df.columns[start : start + COLUMNS_PER_JOB]).collect()
    whole = sequential(measured)
    return fact_table(df.sparkSession, measured, gap_facts(df, whole).collect() if whole else [])


def sequential(measured: list) -> dict[str, bool]:
    """Columns whose values may count up, and whether they are whole numbers."""
    return {
        r["column"]: r["integer_like"] and r["min_value"] == int(r["min_value"])
        for r in measured
        if r["family"] == "numeric" and r["distinct"] > 25 and r["distinct"] > 0.98 * r["non_null"]
    }


def fact_table(spark, measured: list, gaps: list) -> DataFrame:
    by_name = {r["column"]: r for r in gaps}
    rows = []
    for r in measured:
        g = by_name.get(r["column"])
        rows.append((*r, g["unit_gaps"] if g else 0, g["close_gaps"] if g else 0))
    return small_table(spark, sorted(rows, key=lambda r: r[0]), FACT_SCHEMA)


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Number of rows equal to another earlier row; nulls are equal to nulls.

    Rows are grouped by two independent 64-bit hashes over all cells and a null mask,
    so 16 bytes and a count are shuffled per distinct row instead of the whole row
    (at 10^12 rows the chance of any collision is about 10^-15).
    """
    return repeats(row_groups(df, names))


def row_groups(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``h1, h2, n``: one row for each distinct row."""
    cells = [col(n) for n in names or df.columns]
    mask = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cells])
    keyed = df.select(
        F.xxhash64(mask, *cells).alias("h1"), F.xxhash64(F.lit(7), mask, *cells).alias("h2")
    )
    return keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def repeats(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def overview(df: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: size, missing cells, duplicates, constants and the emptiest column."""
    return overview_of(facts, duplicate_rows(df))


def overview_of(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    missing = F.col("rows") - F.col("non_null")
    totals = facts.agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("rows").alias("cells"),
        F.sum(missing).alias("missing_cells"),
        F.count_if(F.col("distinct") <= 1).alias("constant_columns"),
        F.count_if(F.col("family").isin("numeric", "boolean")).alias("numeric_columns"),
        F.max_by(
            F.when(missing > 0, F.col("column")),
            F.struct(missing, -F.col("position")),
        ).alias("top_missing_column"),
        F.max(missing).alias("top_missing_count"),
    )
    pct = safe_ratio(F.col("top_missing_count"), F.col("rows")) * 100
    return beside(totals.withColumn("top_missing_pct", pct), duplicates)


LANES = [f"lane{i}" for i in range(4)]


def fingerprint_sums(df: DataFrame) -> DataFrame:
    """One row: the number of rows and four sums over their digests; those of two tables add up to those of both.

    A row is the texts of its cells, each behind its length (missing: a dash), so no two rows spell the same.
    """
    texts = [F.hex(col(f.name)) if isinstance(f.dataType, T.BinaryType) else col(f.name).cast("string") for f in df.schema.fields]
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = df.select(F.md5(F.concat(*cells).cast("binary")).alias("h"))
    # Whole numbers add up faster than decimals; the halves of a lane stay exact over 10^14 rows.
    lanes = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(len(LANES))]
    halves = digest.select(*lanes_of(lanes)).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(f"{n}_{half}"), F.lit(0)).cast("decimal(38,0)").alias(f"{n}_{half}") for n in LANES for half in ("high", "low")],
    )
    return halves.select("rows", *[(F.col(f"{n}_high") * 65536 + F.col(f"{n}_low")).cast("decimal(38,0)").alias(n) for n in LANES])


def lanes_of(lanes: list) -> list:
    """High and low 16 bits of each lane."""
    high = [F.shiftright(x, 16).alias(f"{n}_high") for n, x in zip(LANES, lanes, strict=True)]
    return high + [x.bitwiseAND(F.lit(65535)).alias(f"{n}_low") for n, x in zip(LANES, lanes, strict=True)]


def schema_text(df: DataFrame) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def fingerprint(df: DataFrame) -> DataFrame:
    """Content and schema hash, independent of row order and partitioning; one scan."""
    return sealed(fingerprint_sums(df), schema_text(df))


def sealed(sums: DataFrame, schema: str) -> DataFrame:
    parts = [F.lit(schema), *[F.col(c).cast("string") for c in ("rows", *LANES)]]
    return sums.select(F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most n rows, the same for any partitioning: the n smallest salted key hashes."""
    rank = F.md5(F.concat_ws("#", *[col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(rank, *[col(k) for k in key]).limit(n)
