"""Independent SQL for the profile rules, shared by the oracles.

``roles_sql`` writes the whole chain from a source relation ``t`` to a ``roles``
relation with one row per column.
"""

from __future__ import annotations

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "%B %d, %Y"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "%b %d, %Y"),
    (r"^\d{4}$", "%Y"),
]
OUTCOMES = "['attrition','churn','churned','converted','conversion','default','fraud','label','outcome','response','target']"
AUTO = "['attrition','churn','converted','conversion','default','fraud','label','outcome','response','target']"
POSITIVE = "['amount','approved','churn','class','conversion','default','defect','demand','failed','fraud','grade','label','loss','outcome','passed','price','probability','result','retained','revenue','risk','sales','score','segment','status','success','survived','target','value']"
NEGATIVE = "['address','cast','comment','customer','description','director','email','first','last','latitude','longitude','message','name','notes','phone','text','title','url','uuid']"
TEMPORAL = "['created','date','day','month','released','time','timestamp','updated','year']"
STOPWORDS = "['actual','class','label','level','result','score','status','target','type','value']"
SENSITIVE = "['age','disability','ethnicity','gender','nationality','race','religion','sex']"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def date_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN try_strptime({x}, '{f}')" for p, f in DATES)
    return f"CASE {whens} END"


def number_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN TRY_CAST({x} AS DOUBLE) END"


def words_sql(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({x}, ' \t\n\r '), '\\s+')) END"


def general_tokens(x: str) -> str:
    parts = f"[lower(p) for p in regexp_split_to_array({x}, '[^A-Za-z0-9]+') if p <> '']"
    camel = f"[lower(p) for p in regexp_extract_all({x}, '[A-Z]?[a-z]+|\\d+')]"
    return f"(CASE WHEN len({parts}) = 1 AND len({camel}) > 0 THEN {camel} ELSE {parts} END)"


def camel_tokens(x: str) -> str:
    spaced = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"[lower(p) for p in regexp_split_to_array({spaced}, '[^A-Za-z0-9]+') if p <> '']"


def plain_tokens(x: str) -> str:
    return f"[p for p in regexp_split_to_array(lower({x}), '[^a-z0-9]+') if p <> '']"


def whole_sql(x: str) -> str:
    r = f"round_even({x}, 0)"
    return f"abs({x} - {r}) <= 1e-9 + 1e-5 * abs({r})"


def facts_sql(spec: list[tuple[str, str, str]], source: str = "t") -> str:
    parts = []
    for i, (name, dtype, family) in enumerate(spec):
        c = q(name)
        if family == "numeric":
            extra = (
                f"NULL::BIGINT AS numeric_ok, NULL::BIGINT AS date_ok, NULL::BIGINT AS words, NULL::BIGINT AS chars, "
                f"coalesce(bool_and({whole_sql('CAST(v AS DOUBLE)')}), false) AS integer_like, min(v)::DOUBLE AS min_value, max(v)::DOUBLE AS max_value, "
                f"(SELECT count(*) FROM (SELECT {c} - lag({c}) OVER (ORDER BY {c}) AS d FROM {source} WHERE {c} IS NOT NULL) WHERE d = 1) AS unit_gaps"
            )
        elif dtype == "string":
            extra = (
                f"coalesce(sum(n) FILTER (WHERE {number_sql('v')} IS NOT NULL), 0)::BIGINT AS numeric_ok, "
                f"coalesce(sum(n) FILTER (WHERE {date_sql('v')} IS NOT NULL), 0)::BIGINT AS date_ok, "
                f"coalesce(sum(n * {words_sql('v')}), 0)::BIGINT AS words, coalesce(sum(n * length(v)), 0)::BIGINT AS chars, "
                f"coalesce(bool_and(coalesce({whole_sql(f'({number_sql(chr(118))})')}, false)), false) AS integer_like, "
                f"min({number_sql('v')}) AS min_value, max({number_sql('v')}) AS max_value, 0 AS unit_gaps"
            )
        else:
            extra = (
                "NULL::BIGINT AS numeric_ok, NULL::BIGINT AS date_ok, NULL::BIGINT AS words, NULL::BIGINT AS chars, "
                f"{'true' if family == 'boolean' else 'false'} AS integer_like, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, 0 AS unit_gaps"
            )
        parts.append(
            f"SELECT {i} AS position, '{name}' AS name, '{dtype}' AS dtype, '{family}' AS family, "
            f"(SELECT count(*) FROM {source}) AS row_total, coalesce(sum(n), 0)::BIGINT AS non_null, count(*) AS uniq, "
            f"coalesce(min(n), 0) AS min_count, {extra} "
            f"FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"
        )
    return "facts AS (" + "\nUNION ALL ".join(parts) + ")"


def roles_sql(spec: list[tuple[str, str, str]], source: str = "t") -> str:
    compact = "regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g')"
    entities = "('account','customer','employee','event','order','product','record','row','session','show','transaction','user')"
    named = (
        f"(lower(trim(name)) = 'id' OR starts_with(lower(trim(name)), 'id_') OR ends_with(lower(trim(name)), '_id') "
        f"OR (starts_with({compact}, 'id') AND substr({compact}, 3) IN {entities}) "
        f"OR (ends_with({compact}, 'id') AND substr({compact}, 1, length({compact}) - 2) IN {entities}) "
        f"OR list_has_any({general_tokens('name')}, ['id','uuid','guid','identifier']))"
    )
    return f"""{facts_sql(spec, source)},
ratios AS (SELECT *, coalesce(uniq / nullif(non_null, 0)::DOUBLE, 0) AS unique_ratio,
  coalesce((row_total - non_null) / nullif(row_total, 0)::DOUBLE, 0) AS missing_ratio,
  CASE WHEN dtype = 'string' THEN coalesce(numeric_ok / nullif(non_null, 0)::DOUBLE, 0) WHEN family IN ('numeric','boolean') AND non_null > 0 THEN 1.0 ELSE 0.0 END AS numeric_ratio,
  CASE WHEN dtype = 'string' THEN coalesce(date_ok / nullif(non_null, 0)::DOUBLE, 0) ELSE 0.0 END AS date_ratio
  FROM facts),
flagged AS (SELECT *,
  (uniq > 1 AND {named})
  OR (family IN ('numeric','boolean') AND integer_like AND unique_ratio > 0.98 AND uniq > 25 AND unit_gaps / nullif(non_null - 1, 0)::DOUBLE > 0.9)
  OR (family NOT IN ('numeric','boolean') AND unique_ratio > 0.995 AND uniq > 100) AS is_identifier,
  (uniq > 1 AND list_contains({camel_tokens('name')}, 'id'))
  OR (family = 'numeric' AND unique_ratio > 0.995 AND non_null > 25 AND unit_gaps / nullif(non_null - 1, 0)::DOUBLE > 0.9) AS is_training_identifier,
  family = 'datetime' OR (dtype = 'string' AND non_null > 0 AND date_ratio >= 0.85) AS is_date,
  dtype = 'string' AND non_null > 0 AND (words / non_null::DOUBLE >= 4 OR chars / non_null::DOUBLE >= 30) AS is_text
  FROM ratios),
roles AS (SELECT *,
  CASE WHEN is_identifier THEN 'identifier' WHEN is_date THEN 'datetime' WHEN is_text THEN 'text' WHEN family = 'boolean' THEN 'boolean'
       WHEN family = 'numeric' THEN 'numeric' WHEN uniq BETWEEN 2 AND 20 THEN 'categorical' ELSE 'high_cardinality' END AS role,
  CASE WHEN non_null < 20 OR uniq < 2 THEN NULL WHEN family = 'boolean' OR (dtype = 'string' AND numeric_ratio < 0.95) THEN 'classification'
       WHEN uniq <= 20 AND unique_ratio <= 0.05 THEN 'classification' ELSE 'regression' END AS profile_problem_type,
  CASE WHEN non_null = 0 THEN NULL WHEN family = 'boolean' OR (dtype = 'string' AND numeric_ratio < 0.95) THEN 'classification'
       WHEN (integer_like OR family = 'datetime') AND uniq <= 5 AND unique_ratio <= 0.05 THEN 'classification' ELSE 'regression' END AS problem_type
  FROM flagged)"""


def scores_sql(spec: list[tuple[str, str, str]], source: str = "t") -> str:
    """Continue ``roles`` to a ``scores`` relation with score, blockers and status."""
    crowd = "uniq > least(40, greatest(10, non_null // 3))"
    inter = lambda words: f"list_sort(list_intersect({general_tokens('name')}, {words}))"
    return f"""{roles_sql(spec, source)},
feat AS (SELECT *, CASE WHEN non_null = 0 OR uniq <= 1 OR is_identifier THEN 0 ELSE 1 END AS usable_feature FROM roles),
signals AS (SELECT *, sum(usable_feature) OVER () - usable_feature AS features,
  {inter(POSITIVE)} AS pos_words, {inter(NEGATIVE)} AS neg_words, {inter(TEMPORAL)} AS time_words,
  uniq > 12 AND uniq <= 30 AND unique_ratio <= 0.25 AS fragmented, {crowd} AS crowded FROM feat),
surface AS (SELECT *,
  CASE WHEN len(pos_words) > 0 THEN 2.5 ELSE 0 END - CASE WHEN len(neg_words) > 0 THEN 1 ELSE 0 END
  - CASE WHEN len(time_words) > 0 AND len(pos_words) = 0 THEN 2 ELSE 0 END
  + CASE WHEN non_null < 30 THEN 0 WHEN non_null < 80 THEN 0.5 ELSE 1.5 END
  + CASE WHEN missing_ratio >= 0.45 THEN 0 WHEN missing_ratio >= 0.2 THEN -0.5 ELSE 1 END
  - CASE role WHEN 'identifier' THEN 4 WHEN 'datetime' THEN 2.5 WHEN 'text' THEN 3 ELSE 0 END
  + CASE WHEN problem_type <> 'classification' OR problem_type IS NULL THEN 0 WHEN uniq = 2 THEN 2.5 WHEN uniq BETWEEN 3 AND 12 THEN 2 WHEN fragmented THEN 0.5 WHEN crowded THEN -2 ELSE 0 END
  + CASE WHEN problem_type = 'regression' AND (family = 'numeric' OR numeric_ratio >= 0.95) THEN 1.5 ELSE 0 END
  + CASE WHEN problem_type = 'regression' AND uniq >= 15 THEN 1.5 WHEN problem_type = 'regression' AND uniq < 8 THEN -0.5 ELSE 0 END AS surface_score,
  (len(time_words) > 0 AND len(pos_words) = 0)::INT + (non_null < 30)::INT + (missing_ratio >= 0.45)::INT + (uniq <= 1)::INT
  + (role IN ('identifier','datetime','text'))::INT
  + (problem_type = 'classification' AND uniq <> 2 AND NOT uniq BETWEEN 3 AND 12 AND NOT fragmented AND crowded)::INT
  + (problem_type = 'classification' AND min_count < 3)::INT
  + (unique_ratio > 0.98 AND uniq > 50 AND role <> 'numeric')::INT AS surface_blockers,
  (non_null < 30)::INT + (missing_ratio >= 0.45)::INT + (uniq <= 1)::INT + is_identifier::INT + is_text::INT
  + (problem_type = 'classification' AND (uniq < 2 OR crowded OR min_count < 3))::INT
  + (problem_type = 'regression' AND NOT (family = 'numeric' OR numeric_ratio >= 0.95))::INT
  + (features < 1)::INT AS assess_blockers FROM signals),
points AS (SELECT *,
  CASE WHEN surface_blockers = 0 AND assess_blockers = 0 AND features >= 4 THEN 1.5 WHEN surface_blockers = 0 AND features >= 2 THEN 0.75 ELSE 0 END AS feature_points,
  CASE WHEN surface_blockers = 0 THEN assess_blockers ELSE surface_blockers END AS blocker_count FROM surface),
scores AS (SELECT *, round(surface_score + feature_points, 2)::DOUBLE AS score,
  CASE WHEN blocker_count > 0 THEN 'rejected' WHEN round(surface_score + feature_points, 2) >= 5 THEN 'recommended' ELSE 'possible' END AS status FROM points)"""


def erfc_sql(z: str) -> str:
    """The same Chebyshev-fitted complementary error function, for z >= 0."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + ({z}) * 0.5::DOUBLE))"
    ks = ["0.17087277", "-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"]
    poly = f"{ks[0]}::DOUBLE"
    for k in ks[1:]:
        poly = f"({poly} * {t} + ({k}::DOUBLE))"
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def two_sided_sql(z: str) -> str:
    return erfc_sql(f"(abs({z}) / sqrt(2.0::DOUBLE))")


MEASURES_SQL = "family IN ('numeric','boolean') AND NOT is_identifier AND uniq > 1"
