"""Secret scan with corpus-wide ownership frequency, in Spark column expressions only.

Base spans come from three fixed patterns.  Their places follow from the lengths of the pieces that the
pattern leaves, summed in order within a document, so no character is walked in Python.  The
method adds long mixed tokens without a key word as candidates.  All candidate values are hashed and counted by
distinct owners and repositories over the corpus: a value of one owner that looks random is
*live*, one that several owners hold is a *shared* example.  Added candidates become spans
only where they are live; base spans always stay.

Values are first reduced to one row for each value, owner and repository, with map-side
combining, so an example that a third of all rows hold stays small.  Documents without a match
leave the plan after one scan.

Defined cases: a missing text is empty; a missing owner or repository counts as one name of its own; rows
repeated with the same id and text are scanned once and reported on each row; extra columns
are ignored; an empty table gives an empty table.  Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored, whole_text

# Fixed patterns of the base spans, in the order of their kinds.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that pass the length test
# Added by the method: a long token of letters, digits and marks that stands alone.
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"

KINDS = ("assign", "access", "hex", "mixed")
BASE = KINDS[:3]
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your|xxxx|1234|abcd|test)"


def _matches(text: Column, pattern: str, group: int, found: Column) -> Column:
    """Lengths of the pieces before each match, of the matches, and the values; null without a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(
        found,
        F.arrays_zip(
            F.slice(pieces, 1, F.size(pieces) - 1).alias("gap"),
            F.transform(whole, lambda x: F.length(x)).alias("size"), value.alias("value"),
        ),
    )


def hits(docs: DataFrame, text: str, owner: Column, repository: Column) -> DataFrame:
    """One row for each input row: id, owner, repository, and the matches of each kind (mostly null)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"), whole_text(text).alias("text"),
    )
    value = F.col("text")
    sign = value.contains(":") | value.contains("=")
    flagged = rows.withColumns(
        {
            "f_assign": sign & value.rlike(ASSIGN), "f_access": value.contains("AKIA"),
            "f_hex": value.rlike(HEX), "f_mixed": value.rlike(MIXED),
        }
    )
    matched = flagged.withColumns(
        {k: _matches(value, p, 2 if k == "assign" else 0, F.col(f"f_{k}")) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, MIXED))}
    )
    some = F.col("f_assign") | F.col("f_access") | F.col("f_hex") | F.col("f_mixed")
    return matched.select("doc_id", "owner", "repository", F.when(some, F.xxhash64("text")).alias("text_hash"), *KINDS)


def _passes() -> Column:
    kind, value = F.col("kind"), F.col("value")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return (
        F.when(kind == "assign", F.length(value) >= 6).when(kind == "access", F.length(value) >= 20)
        .when(kind == "mixed", mixed).otherwise(True)
    )


def candidates(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, rank, start, end, value`` of matches that pass the length tests."""
    once = found.where(F.col("text_hash").isNotNull()).dropDuplicates(["doc_id", "text_hash"])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), F.col(k).alias("list")) for i, k in enumerate(KINDS)])
    each = once.select("doc_id", "text_hash", F.explode(kinds).alias("k")).select(
        "doc_id", "text_hash", "k.kind", "k.rank", F.posexplode("k.list").alias("nth", "m")
    )
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(so_far)
    return each.withColumn("end", end).select(
        "doc_id", "text_hash", "kind", "rank", (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.value").alias("value")
    ).where(_passes())


def ownership(found: DataFrame, spans: DataFrame) -> DataFrame:
    """``value_hash, owners, repositories, uses, live``: who holds each candidate value."""
    holders = found.where(F.col("text_hash").isNotNull()).select(
        "doc_id", "text_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")
    )
    values = spans.select("doc_id", "text_hash", F.sha2("value", 256).alias("value_hash"), _live_looking(F.col("value")).alias("looks")).distinct()
    same = holders["doc_id"].eqNullSafe(values["doc_id"]) & (holders["text_hash"] == values["text_hash"])
    held = holders.join(values, same).groupBy("value_hash", "owner", "repository").agg(
        F.count("*").alias("uses"), F.max("looks").alias("looks")
    )
    by_owner = held.groupBy("value_hash", "owner").agg(
        F.count("*").alias("repositories"), F.sum("uses").alias("uses"), F.max("looks").alias("looks")
    )
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"),
        (F.max("looks") & (F.count("*") == 1)).alias("live"),
    )


def _live_looking(value: Column) -> Column:
    """No placeholder word, letters and digits both, at least eight different characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return ~value.rlike(PLACEHOLDER) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (distinct >= 8)


def labelled_spans(found: DataFrame) -> DataFrame:
    """Base spans and live added spans with ``owners``, ``repositories`` and ``live``.

    An added span that lies within a base span of its text says nothing new and is left out.
    """
    spans = stored(candidates(found), "secret-spans")
    known = ownership(found, spans)
    joined = spans.withColumn("value_hash", F.sha2("value", 256)).join(known, "value_hash")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "text_hash", "start")
    base_end = F.when(F.col("kind").isin(*BASE), F.col("end"))
    covered = F.greatest(F.max(base_end).over(before), F.max(base_end).over(after))
    return joined.withColumn("covered", covered).where(
        F.col("kind").isin(*BASE) | (F.col("live") & ~(F.coalesce("covered", F.lit(-1)) >= F.col("end")))
    ).drop("covered")


def _listed(items: Column) -> Column:
    ordered = F.transform(F.sort_array(items), lambda x: x["text"])
    return F.array_join(ordered, ",")


def scan(docs: DataFrame, text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row for each input row: counts, spans and the share of live values.

    By default the owner is ``source`` and its repositories are told apart by ``lang``.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    found = stored(hits(docs, text, owner, repository), "secret-hits")
    item = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("text"))
    base = F.col("kind").isin(*BASE)
    by_text = labelled_spans(found).groupBy("doc_id", "text_hash").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.count_if("live").alias("n_live"), F.count_if(F.col("owners") > 1).alias("n_shared"),
        _listed(F.collect_list(F.when(base, item))).alias("base"), _listed(F.collect_list(item)).alias("spans"),
    ).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    ids = found.select("doc_id", "text_hash")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*[f"n_{k}" for k in KINDS], "n_live", "n_shared")]
    return ids.join(by_text, same, "left").select(
        "doc_id", *counts, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans")
    )
