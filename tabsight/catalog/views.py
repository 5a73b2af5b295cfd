"""Derived inputs of the registered queries: whole driver tables, in Spark and in SQL.

The driver tables hold no missing values, units or comma lists, so these views derive
such columns from the tables; every row of the source takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Column types as (name, dtype, family) for the oracle's own profile SQL.
LINEITEM = [
    ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
    ("l_linenumber", "int", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("l_returnflag", "string", "categorical"),
    ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "datetime"),
]
ORDERS = [
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical"),
]

DIRTY_CUSTOMER_SQL = """SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 7 = 0 THEN ' N/A ' WHEN c_custkey % 11 = 0 THEN 'unknown' ELSE concat('  ', c_mktsegment, ' ') END AS segment_raw,
  CASE WHEN c_custkey % 50 = 0 THEN '?' WHEN c_custkey % 53 = 0 THEN '1d' ELSE CAST(c_acctbal AS VARCHAR) END AS balance_txt
FROM customer"""
DIRTY_CUSTOMER = [
    ("c_custkey", "bigint", "numeric"), ("c_nationkey", "int", "numeric"),
    ("segment_raw", "string", "categorical"), ("balance_txt", "string", "categorical"),
]


def dirty_customer(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(k % 7 == 0, " N/A ").when(k % 11 == 0, "unknown")
        .otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment_raw"),
        F.when(k % 50 == 0, "?").when(k % 53 == 0, "1d")
        .otherwise(F.col("c_acctbal").cast("string")).alias("balance_txt"),
    )


CLEAN_CUSTOMER_SQL = f"""SELECT c_custkey, c_nationkey,
  CASE WHEN lower(trim(segment_raw)) NOT IN ('','na','n/a','nan','none','null','unknown','?','-','--') THEN trim(segment_raw) END AS segment_raw,
  CASE WHEN lower(trim(balance_txt)) NOT IN ('','na','n/a','nan','none','null','unknown','?','-','--') THEN trim(balance_txt) END AS balance_txt
FROM ({DIRTY_CUSTOMER_SQL})"""

UNIT_PART_SQL = """SELECT p_partkey, p_type,
  CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_size AS VARCHAR), ' min') WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ' Seasons') ELSE concat(CAST(p_size AS VARCHAR), ' mins') END AS size_txt
FROM part"""


def unit_part(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    r = F.col("p_partkey") % 3
    return table(spark, sf, "part").select(
        "p_partkey", "p_type",
        F.when(r == 0, F.concat(size, F.lit(" min"))).when(r == 1, F.concat(size, F.lit(" Seasons")))
        .otherwise(F.concat(size, F.lit(" mins"))).alias("size_txt"),
    )


MULTI_ORDER_SQL = """SELECT l_orderkey, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""


def multi_order(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    pairs = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type").distinct()
    return pairs.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list("p_type")), ", ").alias("types")
    )


LABELED_DOCS_SQL = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
LABELED_DOCS = [
    ("doc_id", "bigint", "numeric"), ("lang", "string", "categorical"), ("source", "string", "categorical"),
    ("n_chars", "bigint", "numeric"), ("quality", "int", "numeric"), ("toxic", "int", "numeric"),
]


def labeled_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


# The same rows under names that the name rules react to.
NAMED_DOCS_SQL = """SELECT d.doc_id, d.lang AS ethnicity, d.source AS created_source, d.n_chars AS text_value,
  l.quality AS label, l.toxic AS toxic_label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
NAMED_DOCS = [
    ("doc_id", "bigint", "numeric"), ("ethnicity", "string", "categorical"), ("created_source", "string", "categorical"),
    ("text_value", "bigint", "numeric"), ("label", "int", "numeric"), ("toxic_label", "int", "numeric"),
]


def named_docs(spark: SparkSession, sf: str) -> DataFrame:
    return labeled_docs(spark, sf).toDF(*[c for c, _, _ in NAMED_DOCS])


SCORED_DOCS_SQL = f"""SELECT doc_id, lang, quality, round(((doc_id * 37) % 101) / 100.0::DOUBLE, 2) AS score,
  CASE WHEN (doc_id * 37) % 101 >= 50 THEN 1 ELSE 0 END AS pred
FROM ({LABELED_DOCS_SQL})"""


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    r = (F.col("doc_id") * 37) % 101
    return labeled_docs(spark, sf).select(
        "doc_id", "lang", "quality",
        F.round(r / F.lit(100.0), 2).alias("score"),
        F.when(r >= 50, 1).otherwise(0).alias("pred"),
    )


CUTOFF = "1999-01-01 00:00:00"
TRAIN_ORDERS_SQL = f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}'"
EXT_ORDERS_SQL = f"SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'"


def train_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz"))


def ext_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz"))


DATED_ORDERS_SQL = "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS date_txt FROM orders"


def dated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("date_txt")
    )


SPARSE_EVENTS_SQL = """SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  event_id % 24 AS hour_slot FROM events"""
SPARSE_EVENTS = [
    ("event_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
    ("value", "double", "numeric"), ("hour_slot", "bigint", "numeric"),
]


def sparse_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        (F.col("event_id") % 24).alias("hour_slot"),
    )


PRICED_LINES_SQL = """SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * l_tax AS tax_amt, l_returnflag FROM lineitem"""
PRICED_LINES = [
    ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"), ("net", "double", "numeric"),
    ("tax_amt", "double", "numeric"), ("l_returnflag", "string", "categorical"),
]


def priced_lines(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        (price * (F.lit(1) - F.col("l_discount"))).alias("net"),
        (price * F.col("l_tax")).alias("tax_amt"),
        "l_returnflag",
    )
