"""Document fingerprints by winnowing, in Spark column expressions only.

Tokens are the runs of a lower-cased text between ASCII white space.  With ``rolling`` a run over
``TOKEN_CHARS`` characters, as in scripts without spaces, has a token at each character, the ``RUN_CHARS``
characters from there on, so no token depends on where the run starts; without, it is cut every
``TOKEN_CHARS`` characters.  The hash of a k-gram is the cyclic polynomial of its token hashes, the value
that a rolling update gives; it is composed of two shorter k-grams each step, so
a whole text takes a logarithmic number of array passes.  Window minima are composed the same way.  A
minimum carries its position, and of equal hashes in a window the rightmost is chosen.  Any run
of ``window + k - 1`` tokens that two texts share gives both at least one equal fingerprint; inside long
runs and with ``rolling`` that is a passage of ``window + k + RUN_CHARS - 2`` characters.

The edited text of a document ends with the start of the next document (descending ``doc_id``).  Ids
fall into blocks of ``BLOCK_IDS``; the top row of the next lower block joins each block as a copy, so
neighbours meet inside a block, no window spans all rows, and each text is shuffled once.

Defined cases: a missing text is empty; a text with fewer tokens than k has one k-gram of all its tokens,
one without tokens none; two fingerprints without hashes are alike (1.0), one without and one with are not (0.0);
repeated ids follow each other by text; a row without ``doc_id`` has no next document (its next text is
empty); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored, whole_text

GRAM_TOKENS = 4
WINDOW_GRAMS = 8
TOKEN_CHARS = 32
RUN_CHARS = 8
POSITION_BITS = 30
BLOCK_IDS = 128
GROUP_BLOCKS = 4_096
BROADCAST_ROWS = 1_000_000


def _rotated(value: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value


def _from(array: Column, start: int) -> Column:
    """The array from a zero-based place on; empty behind its end."""
    return F.slice(array, start + 1, F.greatest(F.size(array) - start, F.lit(0)))


def tokens(text: Column, rolling: bool) -> Column:
    """Tokens of a text; group 1 is a whole short run, or the characters from a place in a long one."""
    char = r"[^ \t\n\x0B\f\r]"
    if not rolling:
        return F.regexp_extract_all(F.lower(text), F.lit(f"{char}{{1,{TOKEN_CHARS}}}"), F.lit(0))
    short = rf"(?<!{char}){char}{{1,{TOKEN_CHARS}}}+(?!{char})"
    pattern = rf"(?=({short}|{char}{{1,{RUN_CHARS}}}+))(?:(?<!{char})\1(?!{char})|{char})"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def with_fingerprint(
    df: DataFrame, text: str, out: str, k: int = GRAM_TOKENS, window: int = WINDOW_GRAMS, rolling: bool = True
) -> DataFrame:
    """Adds ``<out>_hash`` (array of long) and ``<out>_pos`` (array of int): the chosen k-grams."""
    h, m, n = f"__{out}_h", f"__{out}_m", f"__{out}_n"
    df = df.withColumn(f"__{out}_1", F.transform(tokens(F.col(text), rolling), lambda w: F.xxhash64(w)))

    def grams(df: DataFrame, length: int, have: dict[int, str]) -> tuple[DataFrame, str]:
        """H(a + b)[i] = H(a)[i] rotated by b, xor H(b)[i + a]; nothing stands behind the end."""
        if length in have:
            return df, have[length]
        b = length // 2
        df, left = grams(df, length - b, have)
        df, right = grams(df, b, have)
        name = f"__{out}_{length}"
        joined = F.zip_with(
            F.col(left), _from(F.col(right), length - b),
            lambda x, y: _rotated(x, b).bitwiseXOR(F.coalesce(y, F.lit(0).cast("long"))),
        )
        have[length] = name
        return df.withColumn(name, joined), name

    df, last = grams(df, k, {1: f"__{out}_1"})
    size = F.size(f"__{out}_1")
    df = df.withColumn(h, F.slice(F.col(last), 1, F.greatest(size - (k - 1), F.least(size, F.lit(1)))))
    low = (1 << POSITION_BITS) - 1
    packed = F.transform(
        F.col(h),
        lambda x, i: F.shiftleft(F.shiftrightunsigned(x, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.lit(low) - i.cast("long")),
    )
    df = df.withColumn(m, packed)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        df = df.withColumn(m, F.zip_with(F.col(m), _from(F.col(m), step), lambda x, y: F.least(x, y)))
        reach += step
    size = F.size(h)
    windows = F.slice(F.col(m), 1, F.greatest(size - (window - 1), F.least(size, F.lit(1))))
    place = F.transform(
        F.array_distinct(windows), lambda x: (F.lit(low) - x.bitwiseAND(F.lit(low))).cast("int")
    )
    df = df.withColumn(f"{out}_pos", place)
    df = df.withColumn(f"{out}_hash", F.transform(F.col(f"{out}_pos"), lambda p: F.element_at(F.col(h), p + 1)))
    made = {c for c in df.columns if c.startswith(f"__{out}_")}
    return df.select(*[c for c in df.columns if c not in made])


def likeness(left: Column, right: Column) -> Column:
    """Shared share of two sets of hashes; 1 where both are empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right)) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def written(name: str) -> Column:
    """``position:hash`` of each chosen k-gram, comma-joined."""
    pairs = F.zip_with(
        F.col(f"{name}_pos"), F.col(f"{name}_hash"), lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.hex(h)))
    )
    return F.array_join(pairs, ",")


def _whole_blocks(column: str, size: int) -> Column:
    """Blocks of ``size`` below a value: exact for any long, rounded down for negative ones too."""
    return F.expr(f"({column} - pmod({column}, {size})) div {size}")


def _below(keys: DataFrame) -> DataFrame:
    """``key, below`` from ``key, top``: the ``top`` of the next lower key; null for the lowest.

    Keys meet in groups of GROUP_BLOCKS consecutive values, and groups one level up in the
    same way, so no window holds more than GROUP_BLOCKS rows.
    """
    span = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if span.lo is None or span.hi - span.lo < GROUP_BLOCKS:
        whole = Window.partitionBy(F.lit(0)).orderBy(F.col("key").desc())
        return keys.select("key", F.lead("top").over(whole).alias("below"))
    group = _whole_blocks("key", GROUP_BLOCKS)
    inside = Window.partitionBy("group").orderBy(F.col("key").desc())
    near = keys.withColumn("group", group).withColumn("near", F.lead("top").over(inside))
    tops = stored(keys.groupBy(group.alias("key")).agg(F.max_by("top", "key").alias("top")), "winnow-blocks")
    far = _below(tops).select(F.col("key").alias("group"), "below")
    return near.join(far, "group").select("key", F.coalesce("near", "below").alias("below"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` rows with a ``block`` in which the next document stands too (``is_copy``)."""
    ids = docs.where(F.col("doc_id").isNotNull())
    blocks = stored(ids.groupBy(_whole_blocks("doc_id", BLOCK_IDS).alias("key")).agg(F.max("doc_id").alias("top")), "winnow-blocks")
    ends = blocks.agg(F.max("top").alias("first"), F.count("*").alias("n")).first()
    guests = _below(blocks).select(
        F.coalesce("below", F.lit(ends.first).cast("long")).alias("doc_id"), F.col("key").alias("guest_of")
    ).groupBy("doc_id").agg(F.collect_list("guest_of").alias("guest_of"))  # at most two: the block above, and the end
    guests = F.broadcast(guests) if ends.n <= BROADCAST_ROWS else guests
    own = F.struct(
        F.coalesce(_whole_blocks("doc_id", BLOCK_IDS), F.xxhash64("text")).alias("block"), F.lit(False).alias("is_copy")
    )
    copies = F.transform(
        F.coalesce("guest_of", F.array().cast("array<bigint>")),
        lambda b: F.struct(b.alias("block"), F.lit(True).alias("is_copy")),
    )
    placed = docs.join(guests, "doc_id", "left").select("doc_id", "text", F.explode(F.concat(F.array(own), copies)).alias("at"))
    return placed.select("doc_id", "text", "at.block", "at.is_copy", F.col("doc_id").isNull().alias("missing"))


def fingerprints(
    docs: DataFrame, text: str = "text", k: int = GRAM_TOKENS, window: int = WINDOW_GRAMS, rolling: bool = True
) -> DataFrame:
    """``doc_id, fp_pos, fp_hash`` of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return with_fingerprint(rows, "text", "fp", k, window, rolling).select("doc_id", "fp_pos", "fp_hash")


def with_edits(
    docs: DataFrame, text: str = "text", k: int = GRAM_TOKENS, window: int = WINDOW_GRAMS, rolling: bool = True
) -> DataFrame:
    """Each text, its edited text, both fingerprints and their likeness; one row for each input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    dealt = with_next(rows).repartition("block", "missing")
    printed = with_fingerprint(dealt, "text", "fp", k, window, rolling)
    order = Window.partitionBy("block", "missing").orderBy("is_copy", F.col("doc_id").desc(), "text")
    following = lambda c, empty: F.when(F.col("missing"), empty).otherwise(F.lead(c).over(order))
    paired = printed.withColumns(
        {
            "next_text": following("text", F.lit("")),
            "next_hash": following("fp_hash", F.array().cast("array<bigint>")),
            "n_chars": F.length("text").cast("long"),
        }
    ).where(~F.col("is_copy"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    return with_fingerprint(paired.withColumn("edited", edited), "edited", "ed", k, window, rolling)


def summary(docs: DataFrame, rolling: bool = True) -> DataFrame:
    """Digest columns of ``with_edits``."""
    return with_edits(docs, rolling=rolling).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("fp").alias("fingerprint"), written("ed").alias("edited_fingerprint"),
        likeness(F.col("fp_hash"), F.col("ed_hash")).alias("near_edited"),
        likeness(F.col("fp_hash"), F.col("next_hash")).alias("near_next"),
    )
