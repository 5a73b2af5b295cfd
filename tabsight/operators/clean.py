"""Cleaning: header checks, missing tokens, target rows and type coercion."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.text import clean_text_sql, col, number_sql, ref, strip, to_datetime

SUPPORTED = (T.NumericType, T.BooleanType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)


def family(dtype: T.DataType) -> str:
    """Raw-schema family of a column type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "categorical"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def check_headers(names: list[str], what: str = "names repeat once trimmed") -> list[str]:
    """Trimmed names; blanks become ``Unnamed: i``; duplicates are an error."""
    trimmed = [(n or "").strip() or f"Unnamed: {i}" for i, n in enumerate(names)]
    repeated = [n for n, k in Counter(trimmed).items() if k > 1]
    if repeated:
        raise ValueError(f"{what}: {repeated}")
    return trimmed


def clean_value(name: str, dtype: T.DataType) -> Column:
    """Missing tokens, NaN and infinities become null; text is trimmed."""
    if isinstance(dtype, T.StringType):
        return F.expr(clean_text_sql(ref(name)))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # NaN is not below infinity either.  Cleaned columns are cleaned again and filters repeat the whole nest, so each mention counts.
        x = ref(name)
        return F.expr(f"CASE WHEN abs({x}) < double('infinity') THEN {x} END")
    if isinstance(dtype, T.DecimalType):
        return col(name).cast("double")
    return col(name)


def sanitize(df: DataFrame) -> DataFrame:
    """One projection that cleans every column and changes no type on a guess."""
    for f in df.schema.fields:
        if not isinstance(f.dataType, SUPPORTED):
            raise ValueError(
                f"Column {f.name} has the nested or binary type {f.dataType.simpleString()}; "
                "flatten it before profiling."
            )
    names = check_headers(df.columns)
    return df.select(
        *[
            clean_value(f.name, f.dataType).alias(new)
            for f, new in zip(df.schema.fields, names, strict=True)
        ]
    )


def coerce_numeric(name: str, dtype: T.DataType) -> Column:
    """Cleaned double of any column; text that is no number becomes null."""
    if isinstance(dtype, T.StringType):
        return F.expr(number_sql(f"({clean_text_sql(ref(name))})"))
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    if family(dtype) == "datetime":
        return F.lit(None).cast("double")
    return clean_value(name, dtype).cast("double")


def coerce_datetime(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return to_datetime(name)
    if family(dtype) == "datetime":
        return col(name).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def target_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows whose cleaned target is present, with the cleaned target in place."""
    cleaned = clean_value(target, df.schema[target].dataType)
    return df.withColumn(target, cleaned).where(col(target).isNotNull())


def usable_target_rows(df: DataFrame, target: str, min_rows: int = fv.MIN_TARGET_ROWS) -> tuple[DataFrame, int]:
    """``target_rows`` plus the number of dropped rows; too few rows are an error."""
    kept = target_rows(df, target)
    cleaned = clean_value(target, df.schema[target].dataType)
    total, usable = df.select(cleaned.alias("t")).agg(F.count(F.lit(1)), F.count("t")).first()
    if usable < min_rows:
        raise ValueError(
            f"{target}: {usable} rows with a value, {min_rows} needed"
        )
    return kept, total - usable


def normalise_target(df: DataFrame, target: str, problem_type: str, all_integral: bool = True) -> DataFrame:
    """Give the target its modelling type.

    Regression becomes double and drops text that is no number.  Classification keeps
    booleans, turns all-integral numbers into long, other numbers into double, and
    leaves text labels as text even when they look numeric.
    """
    dtype = df.schema[target].dataType
    rows = target_rows(df, target)
    if problem_type == "regression":
        rows = rows.withColumn(target, coerce_numeric(target, dtype))
        return rows.where(col(target).isNotNull())
    if family(dtype) == "numeric":
        kind = "bigint" if all_integral else "double"
        value = F.rint(col(target).cast("double")) if all_integral else col(target)
        return rows.withColumn(target, value.cast(kind))
    if family(dtype) == "boolean":
        return rows
    return rows.withColumn(target, strip(col(target).cast("string")))


def enough_values(columns: list[str], minimum: int) -> Column:
    """True where at least ``minimum`` of the columns hold a value."""
    present = F.lit(0)
    for name in columns:
        present = present + col(name).isNotNull().cast("int")
    return present >= minimum
