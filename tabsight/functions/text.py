"""Expressions for names, missing tokens, numbers, dates and units.

There is no Python UDF: everything stays inside whole-stage code generation.  The value
rules that are applied to every cell are written once as SQL text over a column
reference (``*_sql``), so one parsed expression per column replaces hundreds of calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# All characters that count as blank when text is stripped or split into words.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
BLANK_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in BLANKS) + "]"
BLANK_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in BLANKS) + "'"

NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Accepted date texts: a cheap shape test, then the parse format.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}$", "yyyy"),
)


def col(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def ref(name: str) -> str:
    """A column's exact name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_sql(x: str) -> str:
    return f"btrim({x}, {BLANK_LITERAL})"


def clean_text_sql(x: str) -> str:
    """Trim text and turn missing tokens into null."""
    t = strip_sql(x)
    longest = max(len(token) for token in fv.MISSING_TOKENS)
    tokens = ", ".join(literal(token) for token in fv.MISSING_TOKENS)
    return f"CASE WHEN octet_length({t}) > {longest} OR lower({t}) NOT IN ({tokens}) THEN {t} END"


def number_sql(x: str) -> str:
    """Trimmed text to double, null where the text is not a plain decimal number."""
    return f"CASE WHEN {x} RLIKE {literal(NUMBER_PATTERN)} THEN try_cast({x} AS DOUBLE) END"


def datetime_sql(x: str) -> str:
    """Trimmed text to a zone-less timestamp, null where no accepted format fits.

    Length and one combined shape test come first, so ordinary text costs at most one
    pattern match; then the value's own shape picks a single parser.
    """
    any_shape = "|".join(shape for shape, _ in DATE_FORMATS)
    whens = " ".join(
        f"WHEN {x} RLIKE {literal(shape)} THEN try_to_timestamp({x}, {literal(fmt)})"
        for shape, fmt in DATE_FORMATS
    )
    return (
        f"CAST(CASE WHEN octet_length({x}) BETWEEN 4 AND 40 AND {x} RLIKE {literal(any_shape)} "
        f"THEN CASE {whens} END END AS TIMESTAMP_NTZ)"
    )


def words_sql(x: str) -> str:
    """Number of blank-separated words of trimmed text; null and empty text have none."""
    blank = literal(BLANK_CLASS)
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 WHEN {x} RLIKE {blank} "
        f"THEN size(split({x}, {literal(BLANK_CLASS + '+')})) ELSE 1 END"
    )


def digest_sql(x: str) -> str:
    """Grouping key for text: the text itself when short, its 128-bit MD5 when long."""
    return f"CASE WHEN octet_length({x}) > 32 THEN md5({x}) ELSE {x} END"


def to_number(name: str) -> Column:
    """Number of a raw text column."""
    return F.expr(number_sql(strip_sql(ref(name))))


def to_datetime(name: str) -> Column:
    """Timestamp of a raw text column."""
    return F.expr(datetime_sql(strip_sql(ref(name))))


def word_count(name: str) -> Column:
    """Words of a raw text column."""
    return F.expr(words_sql(strip_sql(ref(name))))


def safe_ratio(n: Column, d: Column) -> Column:
    """``n / d`` as double; 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


# -- column names ---------------------------------------------------------------


def _drop_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != F.lit(""))


def name_tokens_general(name: Column) -> Column:
    """Split on punctuation; split camel case only when there was one part."""
    parts = F.transform(_drop_empty(F.split(name, "[^A-Za-z0-9]+")), F.lower)
    camel = F.transform(
        F.regexp_extract_all(name, F.lit(r"([A-Z]?[a-z]+|\d+)"), F.lit(1)), F.lower
    )
    return F.when((F.size(parts) == 1) & (F.size(camel) > 0), camel).otherwise(parts)


def name_tokens_camel(name: Column) -> Column:
    """Split camel case first, then punctuation."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(_drop_empty(F.split(spaced, "[^A-Za-z0-9]+")), F.lower)


def name_tokens_plain(name: Column) -> Column:
    """Lower-case first, then split on punctuation; camel case stays together."""
    return _drop_empty(F.split(F.lower(name), "[^a-z0-9]+"))


def has_any(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


# -- units and comma lists --------------------------------------------------------


def unit_number(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("double")


def unit_name(c: Column, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 2)
    return F.when(found != "", found)


def normalise_unit(unit: Column) -> Column:
    """Lower-case unit with separators and short forms resolved; plural by default."""
    compact = F.regexp_replace(F.lower(strip(unit)), r"[._-]+", " ")
    pairs = [F.lit(x) for pair in fv.UNIT_ALIASES.items() for x in pair]
    plural = F.when(compact.endswith("s"), compact).otherwise(F.concat(compact, F.lit("s")))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), compact), plural)


def comma_items(c: Column) -> Column:
    """Trimmed, non-empty pieces of a comma-separated text."""
    return _drop_empty(F.transform(F.split(c, ","), strip))
