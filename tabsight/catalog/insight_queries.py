"""Registered queries: descriptive evidence and target associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights, profile, targets
from . import views as v
from .oracle import MEASURES_SQL, roles_sql, two_sided_sql
from .profile_queries import _roles
from .registry import query

PRICED = f"t AS ({v.PRICED_LINES_SQL})"
EVENTS = f"t AS ({v.SPARSE_EVENTS_SQL})"
NAMED = f"t AS ({v.NAMED_DOCS_SQL})"


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- correlations -----------------------------------------------------------------------


def correlation_sql(names: list[str]) -> str:
    """Pairs, p-values, adjusted p-values and the gate over relation ``t``."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    body = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}::DOUBLE, {b}::DOUBLE) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, count(*) AS total FROM t"
        for a, b in pairs
    )
    z = "(atanh(CASE WHEN abs(r) < 1 THEN r END) * sqrt(greatest(n - 3, 0)))"
    return f"""pairs AS ({body}),
tested AS (SELECT *, 100.0 * n / total::DOUBLE AS cov, CASE WHEN n < 4 THEN 1.0 WHEN abs(r) >= 1 THEN 0.0 ELSE {two_sided_sql(z)} END AS p FROM pairs WHERE r IS NOT NULL AND NOT isnan(r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM tested),
adjusted AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked),
gated AS (SELECT *, n >= 30 AND cov >= 60 AND abs(r) >= 0.30 AND q <= 0.05 AS eligible FROM adjusted)"""


CORRELATION_SELECT = """SELECT a AS column_a, b AS column_b, round(r, 6) AS correlation, n AS paired_n, round(cov, 6) AS coverage_pct,
  round(p, 6) AS p_value, round(q, 6) AS adjusted_p_value, eligible AS headline_eligible FROM gated
ORDER BY eligible DESC, abs(r) DESC, n DESC, a, b LIMIT 10"""


def _correlations(df):
    out = insights.correlations(*_roles(df))
    return _rounded(out, ["correlation", "coverage_pct", "p_value", "adjusted_p_value"]).select(
        "column_a", "column_b", "correlation", "paired_n", "coverage_pct", "p_value", "adjusted_p_value", "headline_eligible"
    )


@query("correlations", f"WITH {PRICED}, {correlation_sql(['net', 'l_extendedprice', 'tax_amt', 'l_quantity'])} {CORRELATION_SELECT}")
def correlations(spark, sf):
    return _correlations(v.priced_lines(spark, sf))


@query("correlations_with_gaps", f"WITH {EVENTS}, {correlation_sql(['hour_slot', 'value'])} {CORRELATION_SELECT}")
def correlations_with_gaps(spark, sf):
    return _correlations(v.sparse_events(spark, sf))


@query("correlation_columns", f"""WITH t AS (SELECT * FROM lineitem), {roles_sql(v.LINEITEM)}
SELECT name AS "column", non_null, uniq AS "distinct", count(*) OVER () AS candidate_columns,
  row_number() OVER (ORDER BY non_null DESC, uniq DESC, lower(name), name) AS selection_rank, count(*) OVER () - 2 AS omitted_columns FROM roles WHERE {MEASURES_SQL}
QUALIFY row_number() OVER (ORDER BY non_null DESC, uniq DESC, lower(name), name) <= 2""")
def correlation_columns(spark, sf):
    return insights.correlation_columns(_roles(v.table(spark, sf, "lineitem"))[1], limit=2)


@query("bh_adjust", """WITH g AS (SELECT l_suppkey, count(*)::DOUBLE AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY l_suppkey),
p AS (SELECT l_suppkey, least(1.0, exp(-abs(m - 25.5) / (s / sqrt(n)))) AS p_value FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, l_suppkey) AS k, count(*) OVER () AS m FROM p)
SELECT l_suppkey, round(p_value, 6) AS p_value, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted_p_value FROM r""")
def bh_adjust(spark, sf):
    from ..functions.stats import adjust_p

    groups = v.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s")
    )
    p = F.least(F.lit(1.0), F.exp(-F.abs(F.col("m") - 25.5) / (F.col("s") / F.sqrt("n"))))
    return _rounded(adjust_p(groups.select("l_suppkey", p.alias("p_value"))), ["p_value", "adjusted_p_value"])


# -- groups, trends, anomalies ----------------------------------------------------------------


def group_sql(categories: list[str], metrics: list[str]) -> str:
    parts = []
    for ci, c in enumerate(categories):
        for mi, m in enumerate(metrics):
            parts.append(
                f"SELECT {ci} AS ci, {mi} AS mi, '{c}' AS category_column, '{m}' AS metric_column, CAST({c} AS VARCHAR) AS grp, avg({m})::DOUBLE AS mean, count({m}) AS n, "
                f"(SELECT avg({m})::DOUBLE FROM t WHERE {c} IS NOT NULL) AS overall, (SELECT stddev_samp({m}::DOUBLE) FROM t WHERE {c} IS NOT NULL) AS sd, "
                f"(SELECT count(*) FROM t WHERE {c} IS NOT NULL AND {m} IS NOT NULL) AS total FROM t WHERE {c} IS NOT NULL AND {m} IS NOT NULL GROUP BY {c}"
            )
    return f"""levels AS ({' UNION ALL '.join(parts)}),
kept AS (SELECT *, count(*) OVER (PARTITION BY ci, mi) AS k, coalesce((max(mean) OVER (PARTITION BY ci, mi) - min(mean) OVER (PARTITION BY ci, mi)) / nullif(sd, 0), 0) AS spread
  FROM levels WHERE total >= 30 AND n >= greatest(5, ceil(total * 0.01))),
best AS (SELECT ci, mi FROM kept WHERE k >= 2 ORDER BY spread DESC, ci, mi LIMIT 1)
SELECT category_column, metric_column, grp AS "group", round(mean, 4) AS average_value, n AS row_count, round(overall, 4) AS overall_average,
  round(mean - overall, 4) AS difference_from_overall, round(spread, 4) AS standardized_spread FROM kept JOIN best USING (ci, mi)
ORDER BY mean DESC, grp LIMIT 12"""


GROUP_COLUMNS = ["average_value", "overall_average", "difference_from_overall", "standardized_spread"]


@query("group_summary", f"WITH {PRICED}, {group_sql(['l_returnflag'], ['l_quantity', 'l_extendedprice', 'net', 'tax_amt'])}")
def group_summary(spark, sf):
    return _rounded(insights.group_summary(*_roles(v.priced_lines(spark, sf))), GROUP_COLUMNS, 4)


@query("group_summary_with_gaps", f"WITH {EVENTS}, {group_sql(['event_type'], ['value', 'hour_slot'])}")
def group_summary_with_gaps(spark, sf):
    return _rounded(insights.group_summary(*_roles(v.sparse_events(spark, sf))), GROUP_COLUMNS, 4)


def trend_sql(source: str, name: str, unit: str) -> str:
    end = {"year": "INTERVAL 1 YEAR", "month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY"}[unit]
    return f"""WITH t AS ({source}), b AS (SELECT min({name})::DATE AS lo, max({name})::DATE AS hi, count({name}) AS k, count(*) AS total FROM t),
p AS (SELECT date_trunc('{unit}', {name})::DATE AS period, count(*) AS value FROM t WHERE {name} IS NOT NULL GROUP BY 1)
SELECT '{name}' AS date_column, '{unit}' AS frequency, period, value,
  (period = min(period) OVER () AND lo > period) OR (period = max(period) OVER () AND hi < (period + {end} - INTERVAL 1 DAY)::DATE) AS partial,
  round(100.0 * k / total::DOUBLE, 1) AS date_coverage_pct FROM p, b"""


def _trend(df):
    clean_df, r = _roles(df)
    return insights.trend(clean_df, insights.trend_column(r))


@query("trend_year", trend_sql("SELECT * FROM orders", "o_orderdate", "year"))
def trend_year(spark, sf):
    return _trend(v.table(spark, sf, "orders"))


@query("trend_day", trend_sql("SELECT event_type, ts AS ts_time FROM events", "ts_time", "day"))
def trend_day(spark, sf):
    df = v.table(spark, sf, "events").select("event_type", F.col("ts").alias("ts_time"))
    return insights.trend(df, "ts_time")


@query("trend_text_dates", f"WITH d AS ({v.DATED_ORDERS_SQL}), " + trend_sql("SELECT strptime(date_txt, '%B %d, %Y') AS date_txt FROM d", "date_txt", "year").removeprefix("WITH "))
def trend_text_dates(spark, sf):
    return _trend(v.dated_orders(spark, sf))


@query("trend_change", f"""WITH p AS ({trend_sql("SELECT * FROM orders", "o_orderdate", "year")}), c AS (SELECT * FROM p WHERE NOT partial)
SELECT 'o_orderdate' AS date_column, 'year' AS frequency, count(*) AS complete_periods, arg_min(value, period) AS first_value, arg_max(value, period) AS last_value,
  arg_max(value, period) - arg_min(value, period) AS change,
  CASE WHEN arg_min(value, period) >= 30 THEN round((arg_max(value, period) - arg_min(value, period)) / arg_min(value, period)::DOUBLE, 6) END AS change_pct FROM c""")
def trend_change(spark, sf):
    return _rounded(insights.trend_change(_trend(v.table(spark, sf, "orders"))), ["change_pct"])


def anomaly_sql(source: str, names: list[str], key: str, keep: str) -> str:
    need = max(2, -(-len(names) // 2))
    present = " + ".join(f"({n} IS NOT NULL)::INT" for n in names)
    med = ", ".join(f"quantile_cont({n}::DOUBLE, 0.5) AS m_{n}" for n in names)
    mad = ", ".join(f"nullif(quantile_cont(abs({n} - m_{n}), 0.5), 0) AS d_{n}" for n in names)
    zs = [f"0.6745 * abs({n} - m_{n}) / d_{n}" for n in names]
    usable = " + ".join(f"({z} IS NOT NULL)::INT" for z in zs)
    return f"""WITH t AS ({source}), k AS (SELECT * FROM t WHERE {present} >= {need}), m AS (SELECT {med} FROM k), d AS (SELECT {mad} FROM k, m),
s AS (SELECT k.*, greatest({', '.join(zs)}) AS z FROM k, m, d WHERE {usable} >= 2)
SELECT {keep}, round(z, 6) AS anomaly_score FROM s WHERE z >= 4.5 ORDER BY z DESC, {key} LIMIT 10"""


# Squared gaps between value and slot give this table a tail worth flagging.
TAILED_SQL = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, power(value, 3) AS cubed FROM events"


@query("anomaly_rows", anomaly_sql(TAILED_SQL, ["value", "cubed"], "event_id", "event_id, cubed"))
def anomaly_rows(spark, sf):
    df = v.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.pow("value", F.lit(3)).alias("cubed")
    )
    clean_df, r = _roles(df)
    return _rounded(insights.anomaly_rows(clean_df, r, ["event_id"]), ["anomaly_score"]).select("event_id", "cubed", "anomaly_score")


@query("multi_value", f"""WITH t AS ({v.MULTI_ORDER_SQL}), e AS (SELECT DISTINCT l_orderkey, trim(unnest(string_split(types, ','))) AS value FROM t),
c AS (SELECT value, count(*) AS row_count FROM e WHERE value <> '' GROUP BY value)
SELECT 'types' AS "column", value, row_count, round(100.0 * row_count / (SELECT count(*) FROM t)::DOUBLE, 1) AS row_pct, (SELECT count(types) FROM t) AS represented_rows,
  (SELECT count(*) FROM c) AS unique_tokens, (SELECT round(100.0 * avg((contains(types, ','))::INT), 1) FROM t) AS delimiter_coverage_pct
FROM c ORDER BY row_count DESC, value LIMIT 8""")
def multi_value(spark, sf):
    return insights.multi_values(*_roles(v.multi_order(spark, sf).persist()))


@query("unit_summary", f"""WITH t AS ({v.UNIT_PART_SQL}), u AS (SELECT CAST(regexp_extract(size_txt, '^([0-9]+) ([A-Za-z]+)$', 1) AS DOUBLE) AS x,
  CASE lower(regexp_extract(size_txt, '^([0-9]+) ([A-Za-z]+)$', 2)) WHEN 'min' THEN 'minutes' WHEN 'mins' THEN 'minutes' ELSE lower(regexp_extract(size_txt, '^([0-9]+) ([A-Za-z]+)$', 2)) END AS unit FROM t)
SELECT 'size_txt' AS "column", unit, count(*) AS row_count, round(count(*) / (SELECT count(*) FROM t)::DOUBLE * 100, 1) AS coverage_pct, round(avg(x), 2) AS mean,
  round(quantile_cont(x, 0.5), 2) AS median, round(min(x), 2) AS min, round(max(x), 2) AS max FROM u GROUP BY unit""")
def unit_summary(spark, sf):
    return insights.unit_summary(*_roles(v.unit_part(spark, sf)))


# -- target associations ------------------------------------------------------------------------

# Documents with a binary label, two categories and one measure.
ASSOC_CATEGORIES = ["ethnicity", "created_source", "toxic_label"]
LABEL = "1"


def associations_sql() -> str:
    levels = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, count(*) AS n, sum((label = 1)::INT)::BIGINT AS k FROM t GROUP BY {f}"
        for f in ASSOC_CATEGORIES
    )
    wilson = lambda sign: f"(rate + 3.8416 / (2 * n) {sign} 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"
    z = "coalesce(cd / nullif(sqrt(pooled * (1 - pooled) * (1.0 / n + coalesce(1.0 / nullif(m, 0), 0))), 0), 0)"
    err = "sqrt(rate * (1 - rate) / n + coalesce(other * (1 - other) / nullif(m, 0), 0))"
    zn = "coalesce((ma - mb) / nullif(sqrt(va / na + vb / nb), 0), 0)"
    signed = "coalesce((ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / greatest(na + nb - 2, 1)), 0), 0)"
    return f"""tot AS (SELECT count(*)::DOUBLE AS usable, sum((label = 1)::INT)::DOUBLE AS pos FROM t),
raw AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS alln, sum(k) OVER (PARTITION BY feature) AS allk FROM ({levels})),
sup AS (SELECT *, count(*) OVER (PARTITION BY feature) AS levels_left FROM raw, tot WHERE n >= greatest(10, ceil(usable * 0.002))),
r1 AS (SELECT *, k / n::DOUBLE AS rate, alln - n AS m, coalesce((allk - k) / nullif(alln - n, 0)::DOUBLE, 0) AS other, allk / alln::DOUBLE AS pooled FROM sup WHERE levels_left >= 2),
r2 AS (SELECT *, rate - other AS cd, max(rate) OVER (PARTITION BY feature) - min(rate) OVER (PARTITION BY feature) AS eff FROM r1),
cat AS (SELECT 'categorical_rate' AS association_kind, feature, level, n AS row_count, k AS target_count, m::BIGINT AS comparison_count, rate AS target_rate,
  greatest(0, {wilson('-')}) AS lo, least(1, {wilson('+')}) AS hi, other AS comparison_rate, rate - pos / usable AS rate_difference, cd AS comparison_difference,
  cd - 1.96 * {err} AS dlo, cd + 1.96 * {err} AS dhi, NULL::DOUBLE AS signed_effect, eff AS effect_size, abs(cd) AS association_effect, 100 * alln / usable AS coverage_pct, {two_sided_sql(z)} AS p FROM r2),
side AS (SELECT count(*) FILTER (WHERE label = 1) AS na, avg(text_value) FILTER (WHERE label = 1) AS ma, var_samp(text_value) FILTER (WHERE label = 1) AS va,
  count(*) FILTER (WHERE label <> 1) AS nb, avg(text_value) FILTER (WHERE label <> 1) AS mb, var_samp(text_value) FILTER (WHERE label <> 1) AS vb FROM t),
num AS (SELECT 'numeric_difference', 'text_value', '1 versus other target rows', na + nb, na, nb, na / (na + nb)::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, ma - mb,
  ma - mb - 1.96 * sqrt(va / na + vb / nb), ma - mb + 1.96 * sqrt(va / na + vb / nb), {signed}, abs({signed}), abs({signed}), 100 * (na + nb) / usable, {two_sided_sql(zn)} FROM side, tot WHERE na >= 20 AND nb >= 20)"""


RANKED = f"""{associations_sql()},
alls AS (SELECT * FROM cat UNION ALL SELECT * FROM num),
o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM alls),
a AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM o),
g AS (SELECT a.*, row_count >= greatest(30, ceil(usable * 0.01)) AND comparison_count >= greatest(30, ceil(usable * 0.01)) AND coverage_pct >= 60 AND q <= 0.05
  AND CASE WHEN association_kind = 'categorical_rate' THEN association_effect >= 0.10 ELSE association_effect >= 0.30 END AS eligible FROM a, tot)"""


@query("target_overview", """SELECT 'quality' AS target_column, '1' AS positive_label, count(quality) AS usable_rows, count(*) - count(quality) AS missing_rows,
  count(*) FILTER (WHERE quality = 1) AS positive_rows, round(count(*) FILTER (WHERE quality = 1) / count(quality)::DOUBLE, 6) AS positive_rate FROM labels""")
def target_overview(spark, sf):
    return insights.target_overview(v.table(spark, sf, "labels"), "quality", "1")


CAT_COLUMNS = ["target_rate", "target_rate_ci_lower", "target_rate_ci_upper", "comparison_rate", "rate_difference", "comparison_difference", "difference_ci_lower", "difference_ci_upper", "effect_size", "association_effect", "coverage_pct", "p_value"]


@query("target_assoc_categorical", f"""WITH {NAMED}, {associations_sql()}
SELECT feature, level, row_count, target_count, comparison_count, round(target_rate, 6) AS target_rate, round(lo, 6) AS target_rate_ci_lower, round(hi, 6) AS target_rate_ci_upper,
  round(comparison_rate, 6) AS comparison_rate, round(rate_difference, 6) AS rate_difference, round(comparison_difference, 6) AS comparison_difference,
  round(dlo, 6) AS difference_ci_lower, round(dhi, 6) AS difference_ci_upper, round(effect_size, 6) AS effect_size, round(association_effect, 6) AS association_effect,
  round(coverage_pct, 6) AS coverage_pct, round(p, 6) AS p_value FROM cat""")
def target_assoc_categorical(spark, sf):
    out = insights.categorical_associations(*_roles(v.named_docs(spark, sf)), "label", LABEL)
    return _rounded(out, CAT_COLUMNS).select("feature", "level", "row_count", "target_count", "comparison_count", *CAT_COLUMNS)


NUM_COLUMNS = ["comparison_difference", "difference_ci_lower", "difference_ci_upper", "signed_effect", "effect_size", "coverage_pct", "p_value"]


@query("target_assoc_numeric", f"""WITH {NAMED}, {associations_sql()}, alls AS (SELECT * FROM cat UNION ALL SELECT * FROM num)
SELECT feature, level, row_count, target_count, comparison_count, round(comparison_difference, 4) AS comparison_difference, round(dlo, 4) AS difference_ci_lower,
  round(dhi, 4) AS difference_ci_upper, round(signed_effect, 4) AS signed_effect, round(effect_size, 4) AS effect_size, round(coverage_pct, 4) AS coverage_pct, round(p, 4) AS p_value
FROM alls WHERE association_kind = 'numeric_difference'""")
def target_assoc_numeric(spark, sf):
    out = insights.numeric_associations(*_roles(v.named_docs(spark, sf)), "label", LABEL)
    return _rounded(out, NUM_COLUMNS, 4).select("feature", "level", "row_count", "target_count", "comparison_count", *NUM_COLUMNS)


@query("target_assoc_ranked", f"""WITH {NAMED}, {RANKED}
SELECT association_kind, feature, level, row_count, round(association_effect, 6) AS association_effect, round(p, 6) AS p_value, round(q, 6) AS adjusted_p_value, eligible AS headline_eligible FROM g""")
def target_assoc_ranked(spark, sf):
    out = insights.target_associations(*_roles(v.named_docs(spark, sf)), "label", LABEL)
    return _rounded(out, ["association_effect", "p_value", "adjusted_p_value"]).select(
        "association_kind", "feature", "level", "row_count", "association_effect", "p_value", "adjusted_p_value", "headline_eligible"
    )


@query("perfect_levels", f"""WITH t AS (SELECT * REPLACE (CASE WHEN ethnicity = 'fr' THEN 0 ELSE label END AS label) FROM ({v.NAMED_DOCS_SQL})), {RANKED}
SELECT feature, level, row_count, target_count, target_rate FROM g WHERE eligible AND association_kind = 'categorical_rate' AND (target_rate <= 0.001 OR target_rate >= 0.999)
ORDER BY row_count DESC, effect_size DESC, feature, level LIMIT 1""")
def perfect_levels(spark, sf):
    """One language never has the label, so its level is perfect."""
    df = v.named_docs(spark, sf).withColumn("label", F.when(F.col("ethnicity") == "fr", 0).otherwise(F.col("label")))
    return insights.perfect_levels(insights.target_associations(*_roles(df), "label", LABEL))


# -- statements and rankings ----------------------------------------------------------------------


@query("quality_statements", f"""WITH t AS (SELECT * FROM lineitem), {roles_sql(v.LINEITEM)}, h AS (SELECT position, role,
  CASE role WHEN 'identifier' THEN 'key' WHEN 'datetime' THEN 'date' WHEN 'numeric' THEN 'number' WHEN 'text' THEN 'prose'
       WHEN 'categorical' THEN 'category' WHEN 'boolean' THEN 'category' ELSE 'wide category' END AS hint FROM roles),
mix AS (SELECT hint, count(*) AS n, min(position) AS p FROM h GROUP BY hint ORDER BY n DESC, p LIMIT 4),
dup AS (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(c for c, _, _ in v.LINEITEM)})),
lines AS (SELECT 1 AS o, 'roles: ' || string_agg(hint || ' x' || n, ', ' ORDER BY n DESC, p) AS statement FROM mix
  UNION ALL SELECT 2, 'repeated rows: ' || d::BIGINT FROM dup WHERE d > 0
  UNION ALL SELECT 3, 'constant columns: ' || count(*) FROM roles WHERE uniq <= 1 HAVING count(*) > 0
  UNION ALL SELECT 4, 'key columns: ' || count(*) FROM h WHERE role = 'identifier' HAVING count(*) > 0)
SELECT (row_number() OVER (ORDER BY o) - 1)::INT AS place, statement FROM lines""")
def quality_statements(spark, sf):
    df, r = _roles(v.table(spark, sf, "lineitem"))
    return insights.quality_statements(r, profile.overview(df, r))


def _evidence(df, r, target=None, label=None, key=None):
    out = {
        "correlations": insights.correlations(df, r),
        "groups": insights.group_summary(df, r, target),
        "anomalies": insights.anomaly_rows(df, r, key or df.columns[:1]),
        "multi_values": insights.multi_values(df, r),
        "units": insights.unit_summary(df, r),
    }
    dates = insights.trend_column(r)
    if dates:
        out["trend"] = insights.trend(df, dates)
    if target:
        out["associations"] = insights.target_associations(df, r, target, label)
    return out


@query("analysis_paths", f"""WITH {PRICED}, {correlation_sql(['net', 'l_extendedprice', 'tax_amt', 'l_quantity'])},
grp AS ({("SELECT * FROM (WITH " + group_sql(['l_returnflag'], ['l_quantity', 'l_extendedprice', 'net', 'tax_amt']) + ")")}),
ano AS ({anomaly_sql("SELECT *, row_number() OVER () AS rid FROM (" + v.PRICED_LINES_SQL + ")", ['l_quantity', 'l_extendedprice', 'net', 'tax_amt'], 'rid', 'rid')}),
paths AS (SELECT 'Data quality and coverage' AS analysis_type, 45.0::DOUBLE AS score
  UNION ALL SELECT 'Correlation analysis', 70 + least(10 * max(abs(r)), 10) FROM gated WHERE eligible HAVING count(*) > 0
  UNION ALL SELECT 'Descriptive grouping analysis', 58 + least(5 * max(standardized_spread), 8) FROM grp HAVING count(*) > 0
  UNION ALL SELECT 'Robust anomaly review', 56 FROM ano HAVING count(*) > 0
  UNION ALL SELECT 'Descriptive statistics', 48)
SELECT analysis_type, round(score, 2) AS score, row_number() OVER (ORDER BY score DESC, analysis_type) AS rank FROM paths""")
def analysis_paths(spark, sf):
    df, r = _roles(v.priced_lines(spark, sf))
    return _rounded(insights.analysis_paths(_evidence(df, r), profile.overview(df, r), r), ["score"], 2)


@query("findings")
def findings(spark, sf):
    df, r = _roles(v.named_docs(spark, sf))
    evidence = _evidence(df, r, "label", LABEL)
    return insights.findings(evidence, profile.overview(df, r), insights.categorical_summary(df, r))
