"""Registered queries: leakage, features, splits, training, evaluation, scoring, drift, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import col
from ..operators import charts, features, leakage, metrics, scoring, split, training
from ..operators.clean import sanitize
from ..plans import evidence, insight_run, model_run, score_run
from ..session import beside, small_table
from . import views as v
from .insight_queries import _rounded
from .oracle import camel_tokens, scores_sql
from .profile_queries import HINTS, _facts, _roles
from .registry import query

DOCS = f"t AS ({v.LABELED_DOCS_SQL})"
NAMED = f"t AS ({v.NAMED_DOCS_SQL})"
SCORED = f"s AS ({v.SCORED_DOCS_SQL})"

# -- leakage --------------------------------------------------------------------------------

COPY_SQL = """SELECT label, toxic, label AS label_copy, CASE WHEN doc_id % 997 = 5 THEN 1 - label ELSE label END AS near_copy, n_chars, 3.0::DOUBLE * n_chars + 1 AS scaled
FROM (SELECT d.doc_id, l.quality AS label, l.toxic, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _copy_docs(spark, sf):
    k = F.col("doc_id")
    return v.labeled_docs(spark, sf).select(
        F.col("quality").alias("label"), "toxic", F.col("quality").alias("label_copy"),
        F.when(k % 997 == 5, 1 - F.col("quality")).otherwise(F.col("quality")).alias("near_copy"),
        "n_chars", (F.lit(3.0) * F.col("n_chars") + 1).alias("scaled"),
    )


@query("leak_copy", f"WITH t AS ({COPY_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS paired, round(avg((CAST({c} AS VARCHAR) = CAST(label AS VARCHAR))::INT), 6) AS evidence, avg((CAST({c} AS VARCHAR) = CAST(label AS VARCHAR))::INT) >= 0.999 AND count(*) >= 20 AS flagged FROM t"
    for c in ("toxic", "label_copy", "near_copy")))
def leak_copy(spark, sf):
    return _rounded(leakage.copies(_copy_docs(spark, sf), "label", ["toxic", "label_copy", "near_copy"]), ["evidence"])


@query("leak_numeric_copy", f"WITH t AS ({COPY_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS paired, round(abs(corr({c}::DOUBLE, n_chars::DOUBLE)), 6) AS evidence, abs(corr({c}::DOUBLE, n_chars::DOUBLE)) >= 0.9995 AS flagged FROM t"
    for c in ("scaled", "toxic")))
def leak_numeric_copy(spark, sf):
    return _rounded(leakage.numeric_copies(_copy_docs(spark, sf), "n_chars", ["scaled", "toxic"]), ["evidence"])


LEAK_NAMES = [("doc_id", "bigint", "numeric"), ("label", "int", "numeric"), ("label_reason", "string", "categorical"), ("finalLabel", "int", "numeric"), ("lang", "string", "categorical")]


LEAK_FACTS = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_null, count(DISTINCT {c}) AS uniq FROM t" for c, _, _ in LEAK_NAMES)


@query("leak_names", f"""WITH t AS (SELECT d.doc_id, l.quality AS label, d.source AS label_reason, l.toxic AS finalLabel, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
names AS ({LEAK_FACTS}) SELECT name AS "column", non_null, uniq AS "distinct" FROM names WHERE name <> 'label' AND list_has_any({camel_tokens('name')}, ['label'])
  AND list_has_any({camel_tokens('name')}, ['after','final','outcome','reason','result','status'])""")
def leak_names(spark, sf):
    df = v.labeled_docs(spark, sf).select(
        "doc_id", F.col("quality").alias("label"), F.col("source").alias("label_reason"), F.col("toxic").alias("finalLabel"), "lang"
    )
    facts = _facts(df)[1]
    return leakage.suspicious_names(facts, "label").join(facts.select("column", "non_null", "distinct"), "column")


def auc_sql(source: str, x: str, positive: str) -> str:
    return f"""SELECT '{x}' AS "column", count(*) AS paired,
  (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y)::DOUBLE * count(*) FILTER (WHERE NOT y)) AS auc
  FROM (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM (SELECT {x}::DOUBLE AS x, {positive} AS y FROM {source}))"""


@query("leak_auc", f"""WITH {DOCS}, a AS ({auc_sql('t', 'n_chars', 'quality = 1')} UNION ALL {auc_sql('t', 'toxic', 'quality = 1')} UNION ALL {auc_sql('t', 'doc_id', 'quality = 1')})
SELECT "column", paired, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS evidence, greatest(auc, 1 - auc) >= 0.999 AS flagged FROM a""")
def leak_auc(spark, sf):
    out = leakage.separator_auc(v.labeled_docs(spark, sf), "quality", "1", ["n_chars", "toxic", "doc_id"])
    return _rounded(out, ["auc", "evidence"])


@query("leak_time_order", """WITH a AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events), b AS (SELECT o_orderkey, o_orderdate AS ts, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS before FROM orders)
SELECT 'ts' AS "column", count(*) AS paired, (bool_and(coalesce(ts >= before, true)) OR bool_and(coalesce(ts <= before, true))) AS flagged FROM a
UNION ALL SELECT 'o_orderdate', count(*), (bool_and(coalesce(ts >= before, true)) OR bool_and(coalesce(ts <= before, true))) FROM b""")
def leak_time_order(spark, sf):
    a = leakage.time_order(v.table(spark, sf, "events").select("event_id", "ts"), ["ts"], ["event_id"])
    b = leakage.time_order(v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"], ["o_orderkey"])
    return a.unionByName(b).select("column", "paired", "flagged")


PURE_SQL = """SELECT p_type, p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'S' ELSE 'M' END AS kind,
  CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_size AS VARCHAR), ' min') WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ' Seasons') ELSE concat(CAST(p_size AS VARCHAR), ' mins') END AS size_txt,
  concat('r', CAST(p_partkey % 6 AS VARCHAR)) AS kind_reason FROM part"""


def _pure_parts(spark, sf):
    k = F.col("p_partkey")
    return v.unit_part(spark, sf).select(
        "p_type", "p_partkey", F.when(k % 3 == 1, "S").otherwise("M").alias("kind"), "size_txt",
        F.concat(F.lit("r"), (k % 6).cast("string")).alias("kind_reason"),
    )


def purity_sql(f: str, name: str) -> str:
    return f"""SELECT '{name}' AS "column", sum(n)::BIGINT AS paired, count(DISTINCT f) AS levels, round(sum(CASE WHEN top = n_row THEN n_row ELSE 0 END) / sum(n)::DOUBLE, 6) AS evidence FROM (
  SELECT f, n AS n_row, n, row_number() OVER (PARTITION BY f ORDER BY n DESC, k) AS rn, CASE WHEN row_number() OVER (PARTITION BY f ORDER BY n DESC, k) = 1 THEN n END AS top
  FROM (SELECT {f} AS f, kind AS k, count(*) AS n FROM t GROUP BY 1, 2))"""


@query("leak_purity", f"WITH t AS ({PURE_SQL}) {purity_sql('kind_reason', 'kind_reason')} UNION ALL {purity_sql('p_type', 'p_type')} UNION ALL " + purity_sql("lower(regexp_extract(size_txt, '^([0-9]+) ([A-Za-z]+)$', 2))", "size_txt"))
def leak_purity(spark, sf):
    df = _pure_parts(spark, sf)
    out = leakage.level_purity(df, "kind", ["kind_reason", "p_type"]).unionByName(leakage.unit_purity(df, "kind", ["size_txt"]))
    return _rounded(out, ["evidence"]).select("column", "paired", "levels", "evidence")


@query("leakage_report", f"""WITH t AS ({PURE_SQL}), u AS (SELECT count(*) AS n FROM t)
SELECT 'kind_reason' AS "column", 'recorded after outcome' AS rule, 'exclude' AS action FROM u WHERE n > 0
UNION ALL SELECT 'size_txt', 'unit reveals class', 'exclude' FROM (
  SELECT sum(m) / sum(n)::DOUBLE AS purity FROM (SELECT f, max(n) AS m, sum(n) AS n FROM (SELECT regexp_extract(size_txt, '[A-Za-z]+') AS f, kind, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY f)) WHERE purity >= 0.995""")
def leakage_report(spark, sf):
    df, r = _roles(_pure_parts(spark, sf))
    return leakage.screen(df, r, "kind", "classification", "S").select("column", "rule", "action")


@query("entity_overlap", f"""WITH a AS ({v.TRAIN_ORDERS_SQL}), b AS ({v.EXT_ORDERS_SQL})
SELECT 'cust_id' AS "column", count(*) FILTER (WHERE o_custkey IN (SELECT o_custkey FROM a)) AS overlap_rows, count(*) AS total_rows,
  round(count(*) FILTER (WHERE o_custkey IN (SELECT o_custkey FROM a)) / count(*)::DOUBLE, 6) AS overlap_rate FROM b""")
def entity_overlap(spark, sf):
    a, b = (d.select(F.col("o_custkey").alias("cust_id"), "o_totalprice") for d in (v.train_orders(spark, sf), v.ext_orders(spark, sf)))
    return _rounded(leakage.entity_overlap(a, b), ["overlap_rate"])


# -- features -----------------------------------------------------------------------------------


@query("feat_numeric", f"WITH t AS ({v.DIRTY_CUSTOMER_SQL}) SELECT c_custkey, CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 53 <> 0 THEN TRY_CAST(balance_txt AS DOUBLE) END AS balance, c_nationkey::DOUBLE AS nation FROM t")
def feat_numeric(spark, sf):
    df, model = _Fit.model(spark, sf)
    return model.raw(sanitize(df), ["c_custkey"]).select("c_custkey", col("balance_txt").alias("balance"), col("c_nationkey").alias("nation"))


@query("feat_categorical", f"WITH t AS ({v.CLEAN_CUSTOMER_SQL}) SELECT c_custkey, segment_raw AS segment FROM t")
def feat_categorical(spark, sf):
    df, model = _Fit.model(spark, sf)
    return model.raw(sanitize(df), ["c_custkey"]).select("c_custkey", col("segment_raw").alias("segment"))


@query("feat_date_parts", """SELECT o_orderkey, year(o_orderdate)::DOUBLE AS o_orderdate__year, month(o_orderdate)::DOUBLE AS o_orderdate__month,
  day(o_orderdate)::DOUBLE AS o_orderdate__day, (isodow(o_orderdate) - 1)::DOUBLE AS o_orderdate__dayofweek FROM orders""")
def feat_date_parts(spark, sf):
    df = v.table(spark, sf, "orders")
    parts = features.date_parts("o_orderdate", df.schema["o_orderdate"].dataType)
    return df.select("o_orderkey", *[e.alias(n) for n, e in parts.items()])


@query("feat_multi", f"WITH t AS ({v.MULTI_ORDER_SQL}) SELECT l_orderkey, len(string_split(types, ','))::DOUBLE AS item_count, trim(string_split(types, ',')[1]) AS first_item FROM t")
def feat_multi(spark, sf):
    df = v.multi_order(spark, sf)
    return df.select("l_orderkey", features.item_count("types").alias("item_count"), features.first_item("types").alias("first_item"))


@query("feat_unit", f"WITH t AS ({v.UNIT_PART_SQL}) SELECT p_partkey, CAST(string_split(size_txt, ' ')[1] AS DOUBLE) AS number, lower(string_split(size_txt, ' ')[2]) AS unit FROM t")
def feat_unit(spark, sf):
    number, unit = features.unit_parts("size_txt")
    return v.unit_part(spark, sf).select("p_partkey", number.alias("number"), unit.alias("unit"))


@query("feat_words", """WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM documents)
SELECT doc_id, CASE WHEN lower(x) IN ('','na','n/a','nan','none','null','unknown','?','-','--') THEN 0 ELSE len(regexp_split_to_array(x, '\\s+')) END::DOUBLE AS words FROM t""")
def feat_words(spark, sf):
    from ..functions.text import word_count

    df = sanitize(v.table(spark, sf, "documents").select("doc_id", "text"))
    return df.select("doc_id", word_count("text").cast("double").alias("words"))


@query("feat_frequency", f"""WITH tr AS ({v.TRAIN_ORDERS_SQL}), ex AS ({v.EXT_ORDERS_SQL}), f AS (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS share FROM tr GROUP BY 1)
SELECT o_orderkey, round(coalesce(share, 0), 9) AS custkey_frequency FROM ex LEFT JOIN f ON CAST(o_custkey AS VARCHAR) = f.value""")
def feat_frequency(spark, sf):
    key = F.col("o_custkey")
    table = features.frequency_table(v.train_orders(spark, sf), key)
    out = features.frequency_code(v.ext_orders(spark, sf).select("o_orderkey", "o_custkey"), key, table, "custkey_frequency")
    return _rounded(out.drop("o_custkey"), ["custkey_frequency"], 9)


@query("impute_median_mode", f"""WITH t AS ({v.CLEAN_CUSTOMER_SQL}), b AS (SELECT c_custkey, segment_raw, CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 53 <> 0 THEN TRY_CAST(balance_txt AS DOUBLE) END AS balance FROM t),
m AS (SELECT quantile_cont(balance, 0.5) AS med FROM b), k AS (SELECT segment_raw AS top FROM b WHERE segment_raw IS NOT NULL GROUP BY segment_raw ORDER BY count(*) DESC, segment_raw LIMIT 1)
SELECT c_custkey, round(coalesce(balance, med), 6) AS balance, coalesce(segment_raw, top) AS segment FROM b, m, k""")
def impute_median_mode(spark, sf):
    df, model = _Fit.model(spark, sf)
    return model.imputed(df, ["c_custkey"]).select("c_custkey", F.round("balance_txt", 6).alias("balance"), col("segment_raw").alias("segment"))


class _Fit:
    """The label-free feature estimator on the dirty customers."""

    @staticmethod
    def model(spark, sf):
        df = v.dirty_customer(spark, sf).withColumn("flag", (F.col("c_nationkey") % 2).cast("int"))
        return df, features.RawFeatures("flag", "classification", "1", ["c_custkey"]).fit(df)


STANDARD_SQL = f"""WITH t AS ({v.CLEAN_CUSTOMER_SQL}), b AS (SELECT c_custkey, c_nationkey::DOUBLE AS nation, CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 53 <> 0 THEN TRY_CAST(balance_txt AS DOUBLE) END AS balance, segment_raw FROM t),
f AS (SELECT c_custkey, nation, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM b)) AS balance FROM b)"""


@query("standardize", f"""{STANDARD_SQL} SELECT c_custkey, round((nation - (SELECT avg(nation) FROM f)) / (SELECT stddev_pop(nation) FROM f), 6) AS nation,
  round((balance - (SELECT avg(balance) FROM f)) / (SELECT stddev_pop(balance) FROM f), 6) AS balance FROM f""")
def standardize(spark, sf):
    df, model = _Fit.model(spark, sf)
    out = model.prepared(df, ["c_custkey"])
    return out.select("c_custkey", F.round(col("num:c_nationkey"), 6).alias("nation"), F.round(col("num:balance_txt"), 6).alias("balance"))


@query("encode_ordinal", f"""WITH t AS ({v.CLEAN_CUSTOMER_SQL}), l AS (SELECT segment_raw AS seg, row_number() OVER (ORDER BY segment_raw) - 1 AS code FROM (SELECT DISTINCT segment_raw FROM t WHERE segment_raw IS NOT NULL)),
k AS (SELECT segment_raw AS top FROM t WHERE segment_raw IS NOT NULL GROUP BY segment_raw ORDER BY count(*) DESC, segment_raw LIMIT 1)
SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE code END::DOUBLE AS segment_code FROM (SELECT c_custkey, coalesce(segment_raw, top) AS seg FROM t, k) JOIN l USING (seg)""")
def encode_ordinal(spark, sf):
    df, model = _Fit.model(spark, sf)
    unseen = df.withColumn("segment_raw", F.when(F.col("c_custkey") % 13 == 0, "NEVER SEEN").otherwise(F.col("segment_raw")))
    return model.prepared(unseen, ["c_custkey"]).select("c_custkey", col("ord:segment_raw").alias("segment_code"))


# -- splits -------------------------------------------------------------------------------------------

HASH = "md5(concat(CAST(o_orderkey AS VARCHAR), '#42'))"


@query("holdout_split", f"SELECT o_orderkey, CASE WHEN substr({HASH}, 1, 8) < '33333333' THEN 'holdout' ELSE 'train' END AS part FROM orders")
def holdout_split(spark, sf):
    return split.holdout_split(v.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("kfold_assign", f"SELECT o_orderkey, (('0x' || substr({HASH}, 9, 8))::BIGINT % 3)::INT AS fold FROM orders")
def kfold_assign(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", split.fold_column(["o_orderkey"], 3).alias("fold"))


FOLD_HASH = f"md5({HASH} || '#fold')"


@query("holdout_stratified", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.2::DOUBLE + 0.5) THEN 'holdout' ELSE 'train' END AS part FROM r""")
def holdout_stratified(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_holdout(df, ["o_orderkey"], "o_orderstatus")


@query("kfold_stratified", f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {FOLD_HASH}) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN r <= floor(n / 3::DOUBLE + 0.5) THEN 0 WHEN r <= floor(n * (2 / 3::DOUBLE) + 0.5) THEN 1 ELSE 2 END AS fold FROM r""")
def kfold_stratified(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_folds(df, ["o_orderkey"], "o_orderpriority", 3).withColumnRenamed("_fold", "fold")


@query("stratified_sample", f"""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus), q AS (SELECT o_orderstatus, greatest(1, floor(3000.0 * n / (SELECT count(*) FROM orders))) AS quota FROM c)
SELECT o_orderkey, o_orderstatus FROM orders JOIN q USING (o_orderstatus) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}, o_orderkey) <= quota""")
def stratified_sample(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_sample(df, "o_orderstatus", ["o_orderkey"], 3000)


@query("class_balance", """SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share,
  round(min(count(*)) OVER () / sum(count(*)) OVER ()::DOUBLE, 6) AS smallest_share FROM labels GROUP BY quality""")
def class_balance(spark, sf):
    return _rounded(metrics.class_balance(v.table(spark, sf, "labels"), "quality"), ["share", "smallest_share"])


# -- evaluation ---------------------------------------------------------------------------------------------


def class_metrics_sql(actual: str, predicted: str, source: str) -> str:
    """Accuracy and averaged scores over relation ``source``; columns as in the operator."""
    return f"""SELECT sum(hits)::DOUBLE / sum(sup) AS accuracy, avg(hits / nullif(sup, 0)::DOUBLE) AS balanced_accuracy, sum(sup * coalesce(hits / nullif(gu, 0)::DOUBLE, 0)) / sum(sup) AS precision,
  sum(sup * coalesce(hits / nullif(sup, 0)::DOUBLE, 0)) / sum(sup) AS recall, sum(sup * 2.0::DOUBLE * hits / (sup + gu)) / sum(sup) AS f1, avg(2.0::DOUBLE * hits / (sup + gu)) AS f1_macro, sum(sup)::BIGINT AS support
  FROM (SELECT lab, (SELECT count(*) FROM {source} WHERE {actual} = lab) AS sup, (SELECT count(*) FROM {source} WHERE {predicted} = lab) AS gu, (SELECT count(*) FROM {source} WHERE {actual} = lab AND {predicted} = lab) AS hits
        FROM (SELECT {actual} AS lab FROM {source} UNION SELECT {predicted} FROM {source}))"""


METRIC_NAMES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "f1_macro"]
ROUND_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES)


@query("metrics_classification", f"WITH {SCORED}, m AS ({class_metrics_sql('quality', 'pred', 's')}) SELECT {ROUND_METRICS}, support FROM m")
def metrics_classification(spark, sf):
    out = metrics.classification_metrics(metrics.confusion(v.scored_docs(spark, sf), "quality", "pred"))
    return _rounded(out, METRIC_NAMES)


@query("confusion_matrix", f"WITH {SCORED} SELECT CAST(quality AS VARCHAR) AS actual, CAST(pred AS VARCHAR) AS predicted, count(*) AS n FROM s GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return metrics.confusion(v.scored_docs(spark, sf), "quality", "pred")


def ranking_sql(source: str, score: str = "score", y: str = "quality = 1") -> str:
    return f"""c AS (SELECT {score} AS sc, count(*) FILTER (WHERE {y}) AS p, count(*) FILTER (WHERE NOT ({y})) AS n FROM {source} GROUP BY 1),
r AS (SELECT *, sum(p) OVER (ORDER BY sc DESC) AS tp, sum(n) OVER (ORDER BY sc DESC) AS fp FROM c)"""


@query("metrics_ap_auc", f"WITH {SCORED}, {ranking_sql('s')} SELECT round(sum(n * (tp - p / 2.0)) / (sum(p)::DOUBLE * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS average_precision FROM r")
def metrics_ap_auc(spark, sf):
    return _rounded(metrics.ranking_metrics(v.scored_docs(spark, sf), "quality", "score", "1"), ["roc_auc", "average_precision"])


@query("metrics_ap_auc_lines", """WITH c AS (SELECT l_extendedprice AS sc, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, sum(p) OVER (ORDER BY sc DESC) AS tp, sum(n) OVER (ORDER BY sc DESC) AS fp FROM c)
SELECT round(sum(n * (tp - p / 2.0)) / (sum(p)::DOUBLE * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS average_precision FROM r""")
def metrics_ap_auc_lines(spark, sf):
    df = v.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return _rounded(metrics.ranking_metrics(df, "l_returnflag", "l_extendedprice", "R"), ["roc_auc", "average_precision"])


@query("pr_threshold", f"""WITH {SCORED}, {ranking_sql('s')}, f AS (SELECT sc, 2.0::DOUBLE * (tp / (tp + fp)::DOUBLE) * (tp / (SELECT sum(p) FROM c)::DOUBLE) / greatest(tp / (tp + fp)::DOUBLE + tp / (SELECT sum(p) FROM c)::DOUBLE, 1e-12) AS f1 FROM r)
SELECT sc AS threshold, round(f1, 6) AS best_f1 FROM f ORDER BY f1 DESC, sc LIMIT 1""")
def pr_threshold(spark, sf):
    return _rounded(metrics.best_threshold(v.scored_docs(spark, sf), "quality", "score", "1"), ["best_f1"])


REGRESSION_SQL = "SELECT sqrt(avg((quality - score) * (quality - score))) AS rmse, avg(abs(quality - score)) AS mae, 1 - avg((quality - score) * (quality - score)) / var_pop(quality) AS r2, count(*) AS support FROM s"


@query("metrics_regression", f"WITH {SCORED}, m AS ({REGRESSION_SQL}) SELECT round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, support FROM m")
def metrics_regression(spark, sf):
    return _rounded(metrics.regression_metrics(v.scored_docs(spark, sf), "quality", "score"), ["rmse", "mae", "r2"])


BASE_SQL = f"""base AS (SELECT CAST(quality AS VARCHAR) AS majority_label FROM s GROUP BY quality ORDER BY count(*) DESC, 1 LIMIT 1),
bs AS (SELECT s.*, CAST(majority_label AS INT) AS guess, (SELECT avg((quality = 1)::INT) FROM s) AS rate FROM s, base)"""


@query("baseline_metrics", f"WITH {SCORED}, {BASE_SQL}, m AS ({class_metrics_sql('quality', 'guess', 'bs')}) SELECT {ROUND_METRICS}, support, (SELECT majority_label FROM base) AS majority_label, (SELECT round(avg((quality = 1)::INT), 6) FROM s) AS positive_rate FROM m")
def baseline_metrics(spark, sf):
    df = v.scored_docs(spark, sf)
    base = metrics.baseline_classification(df, "quality", "1")
    rows = metrics.constant_predictions(df, base)
    out = beside(metrics.classification_metrics(metrics.confusion(rows, "quality", "majority_label")), base)
    return _rounded(out, [*METRIC_NAMES, "positive_rate"])


@query("quality_verdict", f"""WITH {SCORED}, {BASE_SQL}, {ranking_sql('s')}, ap AS (SELECT sum(p * tp / (tp + fp)::DOUBLE) / sum(p) AS v FROM r), m AS ({class_metrics_sql('quality', 'pred', 's')}), b AS ({class_metrics_sql('quality', 'guess', 'bs')}),
g AS (SELECT (SELECT v FROM ap) AS best, (SELECT f1 FROM m) - (SELECT f1 FROM b) AS f1_gain, (SELECT v FROM ap) - (SELECT avg((quality = 1)::INT) FROM s) AS gain)
SELECT CASE WHEN best >= 0.8 AND (f1_gain >= 0.15 OR gain >= 0.15) THEN 'strong' WHEN best >= 0.6 AND (f1_gain >= 0.05 OR gain >= 0.05) THEN 'useful' ELSE 'weak' END AS verdict,
  round(f1_gain, 6) AS primary_delta, (SELECT round(f1, 6) FROM m) AS best_metric, (SELECT round(f1, 6) FROM b) AS baseline_metric FROM g""")
def quality_verdict(spark, sf):
    df = v.scored_docs(spark, sf)
    model = beside(metrics.classification_metrics(metrics.confusion(df, "quality", "pred")), metrics.ranking_metrics(df, "quality", "score", "1"))
    rows = metrics.constant_predictions(df, metrics.baseline_classification(df, "quality", "1"))
    base = beside(
        metrics.classification_metrics(metrics.confusion(rows, "quality", "majority_label")),
        metrics.ranking_metrics(rows, "quality", "positive_rate", "1"),
    )
    return _rounded(metrics.quality_verdict(model, base, "classification"), ["primary_delta", "best_metric", "baseline_metric"])


@query("prediction_preview", f"WITH {SCORED} SELECT doc_id, quality AS actual, score AS prediction, round_even(score, 0)::BIGINT AS rounded_prediction FROM s ORDER BY doc_id LIMIT 25")
def prediction_preview(spark, sf):
    df = v.scored_docs(spark, sf).select("doc_id", "quality", "score")
    return training.prediction_preview(df, ["doc_id"], "quality", "score", count_target=True)


@query("chart_extracts", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT 'l_extendedprice' AS "column", least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19)::BIGINT AS bucket, l_returnflag AS target, count(*) AS n FROM lineitem, b GROUP BY 2, 3
UNION ALL SELECT 'l_linestatus', CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_returnflag, count(*) FROM lineitem GROUP BY l_linestatus, l_returnflag""")
def chart_extracts(spark, sf):
    df = v.table(spark, sf, "lineitem")
    levels = charts.level_counts(df, "l_linestatus", "l_returnflag")
    return charts.histogram(df, "l_extendedprice", "l_returnflag", 20).unionByName(
        levels.select("column", F.when(F.col("level") == "F", 0).otherwise(1).cast("bigint").alias("bucket"), "target", "n")
    )


LINE_NUMBERS = [c for c, _, f in v.LINEITEM if f == "numeric" and c not in ("l_orderkey", "l_extendedprice")]


@query("chart_features_lines", f"""WITH r AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS place, abs(corr({c}, l_extendedprice)) AS r FROM lineitem" for i, c in enumerate(LINE_NUMBERS))}),
levels AS (SELECT 'l_returnflag' AS name, 1 AS place, count(DISTINCT l_returnflag) AS d FROM lineitem UNION ALL SELECT 'l_linestatus', 2, count(DISTINCT l_linestatus) FROM lineitem)
SELECT 'numeric' AS kind, (row_number() OVER (ORDER BY r DESC, place))::INT AS rank, name AS "column", 'correlation' AS basis FROM r QUALIFY rank <= 2
UNION ALL SELECT 'categorical', (row_number() OVER (ORDER BY place))::INT AS rank, name, 'order' FROM levels WHERE d BETWEEN 2 AND 20 QUALIFY rank <= 2""")
def chart_features_lines(spark, sf):
    df, roles = _roles(v.table(spark, sf, "lineitem"))
    return charts.chart_features(df, roles, "l_extendedprice", "regression", names=[*LINE_NUMBERS, "l_returnflag", "l_linestatus"])


# The mean difference between the classes stands for an importance: it needs no model and SQL gives it too.
@query("chart_features_docs", f"""WITH {DOCS}, w AS (SELECT 'n_chars' AS name, abs(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0)) AS x FROM t
  UNION ALL SELECT 'quality', abs(avg(quality) FILTER (toxic = 1) - avg(quality) FILTER (toxic = 0)) FROM t),
levels AS (SELECT 'lang' AS name, 1 AS place, count(DISTINCT lang) AS d FROM t UNION ALL SELECT 'source', 2, count(DISTINCT source) FROM t)
SELECT 'numeric' AS kind, (row_number() OVER (ORDER BY x DESC))::INT AS rank, name AS "column", 'importance' AS basis FROM w
UNION ALL SELECT 'categorical', (row_number() OVER (ORDER BY place))::INT, name, 'order' FROM levels WHERE d BETWEEN 2 AND 20""")
def chart_features_docs(spark, sf):
    df, roles = _roles(v.labeled_docs(spark, sf))
    apart = lambda c: F.abs(F.avg(F.when(F.col("toxic") == 1, col(c))) - F.avg(F.when(F.col("toxic") == 0, col(c))))
    weights = df.agg(apart("n_chars").alias("n_chars"), apart("quality").alias("quality")).unpivot([], ["n_chars", "quality"], "feature", "importance")
    return charts.chart_features(df, roles, "toxic", "classification", weights, ["lang", "source", "n_chars", "quality"])


@query("chart_confusion", f"""WITH {SCORED}, labels AS (SELECT DISTINCT quality AS x FROM s)
SELECT a.x::VARCHAR AS actual, b.x::VARCHAR AS predicted, (SELECT count(*) FROM s WHERE quality = a.x AND pred = b.x) AS n FROM labels a, labels b""")
def chart_confusion(spark, sf):
    return charts.confusion_matrix(v.scored_docs(spark, sf), "quality", "pred")


# -- training -------------------------------------------------------------------------------------------------


def _training_docs(spark, sf):
    """Documents with their label; length and language are the raw features."""
    return v.labeled_docs(spark, sf).select("doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").alias("label"))


def _run(spark, sf):
    docs = _training_docs(spark, sf).persist()
    return docs, training.train_model(docs, training.TrainingConfig("label", ("doc_id",)))


@query("model_cv")
def model_cv(spark, sf):
    _, model = _run(spark, sf)
    return training.cv_table(spark, model)


@query("model_run")
def model_run_query(spark, sf):
    docs = _training_docs(spark, sf).persist()
    result = model_run.run(docs, training.TrainingConfig("label", ("doc_id",)), with_insights=False)
    return model_run.summary(result)


@query("model_regression_cv")
def model_regression_cv(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    model = training.train_model(df, training.TrainingConfig("o_totalprice", ("o_orderkey",), "regression"))
    return training.cv_table(spark, model)


@query("permutation_importance")
def permutation_importance(spark, sf):
    _, model = _run(spark, sf)
    return training.permutation_importance(model)


@query("score_rows")
def score_rows(spark, sf):
    docs, model = _run(spark, sf)
    refs = score_run.training_references(model)
    return score_run.score(model, docs, refs).scored


@query("training_reference", f"""WITH t AS ({v.TRAIN_ORDERS_SQL})
SELECT 'o_totalprice' AS "column", 'numeric' AS kind, round(1 - count(o_totalprice) / count(*)::DOUBLE, 6) AS missing_rate, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS "rows" FROM t
UNION ALL SELECT 'o_orderpriority', 'categorical', round(1 - count(o_orderpriority) / count(*)::DOUBLE, 6), NULL, NULL, count(*) FROM t""")
def training_reference(spark, sf):
    df = v.train_orders(spark, sf)
    return _rounded(_rounded(scoring.column_moments(df, ["o_totalprice", "o_orderpriority"], ["o_totalprice"]), ["missing_rate"]), ["mean", "std"], 4)


@query("category_reference", f"WITH t AS ({v.TRAIN_ORDERS_SQL}) SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 9) AS share FROM t GROUP BY o_orderpriority")
def category_reference(spark, sf):
    return _rounded(scoring.category_shares(v.train_orders(spark, sf), ["o_orderpriority"]), ["share"], 9)


# -- scoring, drift, readiness ------------------------------------------------------------------------------------


@query("schema_alignment", f"""WITH t AS ({v.CLEAN_CUSTOMER_SQL}) SELECT 'balance_txt' AS "column", 'not convertible to the numeric training schema' AS warning, count(*) AS affected_rows FROM t WHERE balance_txt = '1d' HAVING count(*) > 0
UNION ALL SELECT 'c_nationkey', 'ignored extra column', 0""")
def schema_alignment(spark, sf):
    df = v.dirty_customer(spark, sf)
    return scoring.align_schema(df, ["balance_txt", "segment_raw"], ["balance_txt"], ["c_custkey", "balance_txt", "segment_raw"])[1]


LABEL_VALUES_SQL = """SELECT CASE o_orderkey % 5 WHEN 0 THEN ' 1 ' WHEN 1 THEN 'Yes' WHEN 2 THEN 'yes' WHEN 3 THEN 'NO' ELSE 'other' END AS value, count(*) AS n FROM orders GROUP BY 1"""


@query("label_mapping", f"WITH c AS ({LABEL_VALUES_SQL}) SELECT value, n, CASE WHEN trim(value) = '1' THEN '1' WHEN lower(value) = 'yes' THEN 'yes' WHEN lower(value) = 'no' THEN 'no' END AS label FROM c")
def label_mapping(spark, sf):
    r = F.col("o_orderkey") % 5
    value = F.when(r == 0, " 1 ").when(r == 1, "Yes").when(r == 2, "yes").when(r == 3, "NO").otherwise("other")
    counts = v.table(spark, sf, "orders").groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.map_labels(counts, small_table(spark, [("1",), ("yes",), ("no",)], "label string"))


@query("evaluation_gate", """WITH c AS (SELECT quality AS v, count(*) AS n FROM labels GROUP BY quality)
SELECT CASE WHEN min(n) < 20 OR count(*) < 2 THEN 'blocked' ELSE 'completed' END AS evaluation_status,
  CASE WHEN sum(n) < 20 THEN 'fewer than 20 labeled rows' WHEN count(*) < 2 THEN 'only one class observed' WHEN min(n) < 20 THEN 'a trained class has fewer than 20 external rows' END AS reason,
  sum(n)::BIGINT AS provided_rows, 0::BIGINT AS unknown_rows, (2 - count(*))::BIGINT AS empty_classes, count(*) FILTER (WHERE n < 20) AS thin_classes FROM c""")
def evaluation_gate(spark, sf):
    counts = v.table(spark, sf, "labels").groupBy(F.col("quality").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    labels = small_table(spark, [("0",), ("1",)], "label string")
    return scoring.evaluation_gate(scoring.map_labels(counts, labels), labels)


@query("external_metrics", f"WITH {SCORED}, {BASE_SQL}, m AS (SELECT 'model' AS source, * FROM ({class_metrics_sql('quality', 'pred', 's')}) UNION ALL SELECT 'baseline', * FROM ({class_metrics_sql('quality', 'guess', 'bs')})) SELECT source, {ROUND_METRICS}, support FROM m")
def external_metrics(spark, sf):
    df = v.scored_docs(spark, sf)
    rows = metrics.constant_predictions(df, metrics.baseline_classification(df, "quality", "1"))
    model = metrics.classification_metrics(metrics.confusion(df, "quality", "pred")).withColumn("source", F.lit("model"))
    base = metrics.classification_metrics(metrics.confusion(rows, "quality", "majority_label")).withColumn("source", F.lit("baseline"))
    return _rounded(model.unionByName(base), METRIC_NAMES)


def _drift_inputs(spark, sf):
    train, ext = v.train_orders(spark, sf), v.ext_orders(spark, sf)
    names, numeric = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"]
    text = ["o_orderstatus", "o_orderpriority"]
    n = scoring.numeric_drift(scoring.column_moments(train, names, numeric), scoring.column_moments(ext, names, numeric))
    c = scoring.categorical_drift(scoring.category_shares(train, text), scoring.category_shares(ext, text))
    return train, ext, n, c


PAIR = f"a AS ({v.TRAIN_ORDERS_SQL}), b AS ({v.EXT_ORDERS_SQL})"
SMD = lambda c: f"abs((SELECT avg({c}) FROM b) - (SELECT avg({c}) FROM a)) / greatest((SELECT stddev_pop({c}) FROM a), 1e-9)"


def tv_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS total_variation_distance, coalesce(sum(q) FILTER (WHERE p IS NULL), 0) AS unseen_category_rate
  FROM (SELECT {c} AS val, count(*) / (SELECT count(*) FROM a)::DOUBLE AS p FROM a GROUP BY 1) FULL JOIN (SELECT {c} AS val, count(*) / (SELECT count(*) FROM b)::DOUBLE AS q FROM b GROUP BY 1) USING (val)"""


@query("drift_numeric", f"WITH {PAIR} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((SELECT avg({c}) FROM a), 4) AS training_mean, round((SELECT avg({c}) FROM b), 4) AS external_mean, round({SMD(c)}, 6) AS standardized_mean_difference" for c in ("o_totalprice", "o_custkey")))
def drift_numeric(spark, sf):
    out = _drift_inputs(spark, sf)[2].where(F.col("kind") == "numeric")
    return _rounded(_rounded(out, ["training_mean", "external_mean"], 4), ["standardized_mean_difference"]).select("column", "training_mean", "external_mean", "standardized_mean_difference")


@query("drift_categorical", f"WITH {PAIR}, d AS ({tv_sql('o_orderstatus')} UNION ALL {tv_sql('o_orderpriority')} UNION ALL {tv_sql('o_custkey')}) SELECT \"column\", round(total_variation_distance, 6) AS total_variation_distance, round(unseen_category_rate, 6) AS unseen_category_rate FROM d")
def drift_categorical(spark, sf):
    train, ext = v.train_orders(spark, sf), v.ext_orders(spark, sf)
    names = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    out = scoring.categorical_drift(scoring.category_shares(train, names), scoring.category_shares(ext, names))
    return _rounded(out, ["total_variation_distance", "unseen_category_rate"])


@query("drift_missing", f"""WITH t AS ({v.SPARSE_EVENTS_SQL}) SELECT 'value' AS "column", round(x, 6) AS training_missing_rate, round(y, 6) AS external_missing_rate, round(abs(y - x), 6) AS missingness_change
FROM (SELECT avg((value IS NULL)::INT) FILTER (WHERE event_type = 'click') AS x, avg((value IS NULL)::INT) FILTER (WHERE event_type <> 'click') AS y FROM t)""")
def drift_missing(spark, sf):
    df = v.sparse_events(spark, sf)
    train, ext = df.where(F.col("event_type") == "click"), df.where(F.col("event_type") != "click")
    out = scoring.numeric_drift(scoring.column_moments(train, ["value"], ["value"]), scoring.column_moments(ext, ["value"], ["value"]))
    names = ["training_missing_rate", "external_missing_rate", "missingness_change"]
    return _rounded(out, names).select("column", *names)


@query("drift_prevalence", f"WITH {PAIR} SELECT round(x, 6) AS training_rate, round(y, 6) AS external_rate, round(y - x, 6) AS prevalence_change FROM (SELECT (SELECT avg((o_orderstatus = 'F')::INT) FROM a) AS x, (SELECT avg((o_orderstatus = 'F')::INT) FROM b) AS y)")
def drift_prevalence(spark, sf):
    train, ext = v.train_orders(spark, sf), v.ext_orders(spark, sf)
    rate = train.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("training_rate"))
    return _rounded(scoring.prevalence_change(rate, ext, "o_orderstatus", "F"), ["training_rate", "external_rate", "prevalence_change"])


@query("drift_level", f"""WITH {PAIR}, d AS ({tv_sql('o_orderstatus')} UNION ALL {tv_sql('o_orderpriority')}), m AS (SELECT greatest({SMD('o_totalprice')}, {SMD('o_custkey')}) AS smd, max(total_variation_distance) AS tv, max(unseen_category_rate) AS un FROM d)
SELECT CASE WHEN smd >= 0.5 OR tv >= 0.2 OR un >= 0.2 THEN 'high' WHEN smd >= 0.2 OR tv >= 0.1 OR un >= 0.05 THEN 'moderate' ELSE 'low' END AS level,
  round(smd, 6) AS max_smd, 0.0::DOUBLE AS max_missingness_change, round(tv, 6) AS max_total_variation, round(un, 6) AS max_unseen_rate,
  (SELECT count(*) FROM b WHERE o_custkey IN (SELECT o_custkey FROM a)) AS identifier_overlap_total, (SELECT round(avg((o_custkey IN (SELECT o_custkey FROM a))::INT), 6) FROM b) AS max_identifier_overlap_rate FROM m""")
def drift_level(spark, sf):
    train, ext, n, c = _drift_inputs(spark, sf)
    out = scoring.drift_level(n, c, scoring.identifier_overlap(ext, train, ["o_custkey"]))
    return _rounded(out, ["max_smd", "max_missingness_change", "max_total_variation", "max_unseen_rate", "max_identifier_overlap_rate"])


@query("readiness", f"""WITH a AS ({v.SCORED_DOCS_SQL}), i AS (SELECT * FROM a WHERE doc_id % 2 = 0), s AS (SELECT * FROM a WHERE doc_id % 2 = 1), {BASE_SQL}, x AS (SELECT (SELECT f1_macro FROM ({class_metrics_sql('quality', 'pred', 'i')})) AS internal, (SELECT f1_macro FROM ({class_metrics_sql('quality', 'pred', 's')})) AS external, (SELECT f1_macro FROM ({class_metrics_sql('quality', 'guess', 'bs')})) AS base)
SELECT CASE WHEN internal - external >= 0.10 OR external <= base + 0.05 THEN 'not deployment-ready' ELSE 'externally validated' END AS status, 'f1_macro' AS metric, 'higher is better' AS metric_direction,
  round(internal, 6) AS internal_value, round(external, 6) AS external_value, round(base, 6) AS external_baseline_value, round(internal - external, 6) AS performance_drop, 0::BIGINT AS identifier_overlap_total FROM x""")
def readiness(spark, sf):
    """Even document ids play the internal holdout, odd ones the external table."""
    inner, df = (v.scored_docs(spark, sf).where(F.col("doc_id") % 2 == i) for i in (0, 1))
    held = metrics.classification_metrics(metrics.confusion(inner, "quality", "pred"))
    rows = metrics.constant_predictions(df, metrics.baseline_classification(df, "quality", "1"))
    model = metrics.classification_metrics(metrics.confusion(df, "quality", "pred"))
    base = metrics.classification_metrics(metrics.confusion(rows, "quality", "majority_label"))
    values = beside(model.select(F.col("f1_macro").alias("external"), F.col("support").alias("rows")), base.select(F.col("f1_macro").alias("baseline")), held.select(F.col("f1_macro").alias("internal")))
    values = values.withColumns({"overlap": F.lit(0).cast("bigint"), "blocked": F.lit(False)})
    return _rounded(scoring.readiness(values, "f1_macro"), ["internal_value", "external_value", "external_baseline_value", "performance_drop"])


# -- export ------------------------------------------------------------------------------------------------------------


@query("aggregate_export", f"""WITH {NAMED}, {scores_sql(v.NAMED_DOCS)},
c AS (SELECT 'column' AS kind, name AS "column", dtype, {HINTS} AS role_hint, round((1 - missing_ratio) * 100, 1) AS coverage_pct, round(missing_ratio * 100, 1) AS missing_pct, uniq AS unique_values,
  NULL::VARCHAR AS status, NULL::VARCHAR AS problem_type, NULL::DOUBLE AS score FROM roles ORDER BY position LIMIT 12),
k AS (SELECT 'target' AS kind, name AS "column", dtype, NULL::VARCHAR AS role_hint, NULL::DOUBLE AS coverage_pct, round(missing_ratio * 100, 1) AS missing_pct, uniq AS unique_values, status, problem_type, score FROM scores
  WHERE status <> 'rejected' ORDER BY CASE status WHEN 'recommended' THEN 2 ELSE 1 END DESC, score DESC, lower(name) DESC LIMIT 5)
SELECT * FROM c UNION ALL SELECT * FROM k""")
def aggregate_export(spark, sf):
    return evidence.aggregate_export(insight_run.profile_table(v.named_docs(spark, sf)))


@query("evidence_long")
def evidence_long(spark, sf):
    docs = _training_docs(spark, sf).persist()
    result = model_run.run(docs, training.TrainingConfig("label", ("doc_id",)))
    scored = score_run.score(result.model, docs, score_run.training_references(result.model)) if result.model else None
    return evidence.evidence_long(result, scored)
