"""Spelling variants of the corpus vocabulary by a variable-length gram index.

A gram dictionary holds all pairs of letters, and a longer gram where the gram before its last letter is frequent, so
frequent grams are replaced by more selective ones.  A word is decomposed into the longest dictionary gram at
each place, without those inside another.  For each word the number of its grams that one edit can touch
is bounded from the dictionary (letters of the gram itself, longer grams that a changed letter could
form, and grams that could then cover it); the other grams of the word stay in any word one edit away, at the
same place or one place further.  So the lists of the rarest grams, one more than that bound, contain
every near word, and only they are merged; each pair is verified by its edit distance.  Words of which an
edit may touch every gram are met among themselves in the same way over pairs of letters, of which
an edit touches two.

The edit lies to the right of such a gram, and then all letters up to its end are equal, or to the left, and then all
from its start on; so each gram has two lists, keyed by the length and these letters.  A list over
``LIST_WORDS`` is cut at the middle of the letters left open, again and again, down to one open letter.  No link
is lost, no list is paired while it is long, and very long lists (at most ``1 / HOT_SHARE`` exist) are
told apart by a broadcast of their keys.

Defined cases: a missing or empty text has no words, a missing ``doc_id`` is the empty text in the noise
digest; repeated rows count each time; ties of forms go to the smallest in code-point order; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored, whole_text

MIN_LETTERS = 7
MIN_COUNT = 2
NOISE = 31
FORM_TIMES = 10
SHORTEST, LONGEST = 2, 4
GRAM_COUNT, GRAM_SHARE = 64, 1 / 20_000
LIST_WORDS = 128
HOT_SHARE = 1 / 20_000
FLUSH_WORDS = 200_000
FORM_STEPS = 5  # doublings: a form is ten times as frequent, so no 64-bit count has over 18 steps
LETTERS = r"[A-Za-zÀ-ÿ]"

POSTING_SCHEMA = "word string, n long, long boolean, left int, right int"


def _counted(rows: Iterator[Counter], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, summed until ``FLUSH_WORDS`` keys are held."""

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), type=pa.string()), pa.array(held.values(), type=pa.int64())], names=names)

    held: Counter = Counter()
    for counts in rows:
        held.update(counts)
        if len(held) >= FLUSH_WORDS:
            yield batch(held)
            held = Counter()
    if held:
        yield batch(held)


def words(docs: DataFrame, text: str = "text", noise: int = NOISE) -> DataFrame:
    """``word, n``: the words of at least ``MIN_LETTERS`` letters that occur ``MIN_COUNT`` times, after the noise.

    With ``h = crc32("<doc_id>:<word>")`` divisible by ``noise``, letter ``h mod length`` of the word is deleted.
    """
    runs = re.compile(LETTERS + "{%d,}" % MIN_LETTERS)

    def of_text(doc_id, value: str) -> Counter:
        seen: Counter = Counter()
        for run, n in Counter(runs.findall(value)).items():
            seen[run.encode("latin-1").lower().decode("latin-1")] += n
        start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
        for word, n in seen.items():
            h = zlib.crc32(word.encode(), start)
            if h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= MIN_LETTERS:
                out[word] += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text")
                for i in range(batch.num_rows):
                    yield of_text(ids[i].as_py(), texts[i].as_py())

        return _counted(each(), ("word", "n"))

    picked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text(text).alias("text"))
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def gram_dictionary(vocabulary: DataFrame) -> dict[str, int]:
    """Grams and their counts: every pair, and a longer gram where the gram before its last letter is frequent.

    Frequent means more than ``GRAM_SHARE`` of all pairs (and ``GRAM_COUNT``), so at most ``1 / GRAM_SHARE`` grams of
    a length are frequent and the dictionary stays within that times the letters, whatever the vocabulary size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    yield Counter(word[p : p + k] for k in range(SHORTEST, LONGEST + 1) for p in range(len(word) - k + 1))

        return _counted(each(), ("gram", "n"))

    counts = stored(vocabulary.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "spelling-grams")
    pairs = counts.where(F.length("gram") == SHORTEST).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    frequent = counts.where(F.col("n") > max(GRAM_COUNT, int(pairs * GRAM_SHARE))).select(F.col("gram").alias("stem"))
    longer = counts.where(F.length("gram") > SHORTEST).withColumn("stem", F.expr("left(gram, length(gram) - 1)"))
    kept = counts.where(F.length("gram") == SHORTEST).union(longer.join(frequent, "stem", "left_semi").select("gram", "n"))
    table = kept.toArrow()
    return dict(zip(table["gram"].to_pylist(), table["n"].to_pylist()))


class GramIndex:
    """Decomposition of words and the bound of grams that one edit touches."""

    def __init__(self, grams: dict[str, int]):
        self.count = grams
        longer = [g for g in grams if len(g) > SHORTEST]
        self.starts = {g[:k] for g in grams for k in range(1, len(g))}
        self.inner = {g[a:b] for g in grams for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}
        self.longest = max(map(len, longer), default=SHORTEST)

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(place, length) of the longest dictionary gram at each place, without those inside another."""
        out, end = [], 0
        for p in range(len(word) - SHORTEST + 1):
            k = min(self.longest, len(word) - p)
            while k > SHORTEST and word[p : p + k] not in self.count:
                k -= 1
            if p + k > end:
                out.append((p, k))
                end = p + k
        return out

    def touched(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one inserted, deleted or replaced letter can touch."""
        n, q = len(word), self.longest
        letter, gap = [0] * (n + 1), [0] * (n + 1)
        formed = [any(word[p:i] in self.starts for p in range(max(0, i - q + 1), i)) for i in range(n + 1)]
        for p, k in grams:
            end = p + k
            for i in range(p, end):
                letter[i] += 1
            for i in range(p + 1, end):
                gap[i] += 1
            for i in range(end, min(n, p + q - 1) + 1):  # to the right: a gram from here or before could grow over it
                if formed[i] and any(word[x:i] in self.starts for x in range(max(0, i - q + 1), p + 1)):
                    letter[i] += 1
                    gap[i] += 1
            for i in range(max(0, end - q), p + 1):  # to the left: a new gram could cover it
                if i < p and word[i + 1 : end] in self.inner:
                    letter[i] += 1
                if word[i:end] in self.inner:
                    gap[i] += 1
        return max(max(letter), max(gap))

    def rare(self, word: str, grams: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The ``n`` rarest grams, in one order for all words."""
        ordered = sorted((self.count.get(word[p : p + k], 0), word[p : p + k], p) for p, k in grams)
        return [(p, len(gram)) for _, gram, p in ordered[:n]]

    def signature(self, word: str) -> Iterator[tuple[int, int]]:
        """(place, length) of the grams whose lists hold every near word."""
        grams = self.decompose(word)
        touched = self.touched(word, grams)
        yield from self.rare(word, grams, touched + 1)  # all of them, if an edit may touch each
        if touched >= len(grams):
            yield from self.rare(word, [(p, SHORTEST) for p in range(len(word) - SHORTEST + 1)], SHORTEST + 1)

    def lists(self, word: str) -> set[tuple[bool, int, int]]:
        """(long, left, right) of the lists of a word: how many letters are fixed at both ends.

        A word is in lists of its own length, and as the long word in those of a length less: its gram then stands at
        the same place of the shorter word (the edit is to the right) or one before (to the left).
        """
        size, out = len(word), set()
        for p, k in self.signature(word):
            out |= {(False, p + k, 0), (False, 0, size - p)}
            if p + k < size:
                out.add((True, p + k, 0))
            if p:
                out.add((True, 0, size - p))
        return out


def postings(vocabulary: DataFrame, index: GramIndex) -> DataFrame:
    """A row for each list that a word is in."""
    spark = vocabulary.sparkSession
    shared = spark.sparkContext.broadcast(index)  # bounded, see gram_dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                part = batch.slice(start, 2_048)
                rows = [
                    (word, n, *where)
                    for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()) for where in shared.value.lists(word)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=LIST)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return vocabulary.repartition(parts, "word").mapInArrow(run, POSTING_SCHEMA)


LIST = ["word", "n", "long", "left", "right"]


def _size():
    """Length of the shorter words of a list."""
    return F.length("word") - F.col("long").cast("int")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their list: its length and the letters fixed at both ends."""
    ends = [F.col("left"), F.col("right"), F.expr("left(word, left)"), F.expr("right(word, right)")]
    return rows.select(*LIST, F.xxhash64(_size(), *ends).alias("key"))


def _by_size(lists: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of lists up to ``limit`` words and of longer ones."""
    counts = stored(lists.groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > limit), "spelling-long")
    total = lists.count()
    hot = F.broadcast(counts.where(F.col("words") > max(limit, int(total * HOT_SHARE))).select("key"))
    rest = lists.join(hot, "key", "left_anti").join(counts.withColumn("is_long", F.lit(True)), "key", "left")
    short = rest.where("is_long is null").select(*lists.columns)
    return short, lists.join(hot, "key", "left_semi").unionByName(rest.where("is_long").select(*lists.columns))


def _verified(lists: DataFrame) -> DataFrame:
    """``x, nx, y, ny``: pairs of a list that are one edit apart."""
    x = lists.where("not long").select("key", F.col("word").alias("x"), F.col("n").alias("nx"))
    y = lists.select("key", F.col("word").alias("y"), F.col("n").alias("ny"), "long")
    return x.join(y, "key").where((F.col("long") | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1)).select("x", "nx", "y", "ny")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of lists that are too long, in two narrower lists each: the edit is in one half of the open letters."""
    opened = _size() - F.col("left") - F.col("right")
    half = F.greatest(F.floor(opened / 2), F.lit(1)).cast("int")
    ways = F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right").alias("right")),
        F.struct(F.col("left").alias("left"), (F.col("right") + opened - F.when(opened > 1, half).otherwise(0)).alias("right")),
    )
    return _keyed(rows.withColumn("way", F.explode(ways)).withColumns({"left": F.col("way.left"), "right": F.col("way.right")})).distinct()


def near_pairs(vocabulary: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``x, nx, y, ny``: every pair of words one edit apart, once, over ``word, n``."""
    lists, found = stored(_keyed(postings(vocabulary, GramIndex(gram_dictionary(vocabulary)))), "spelling-lists"), []
    opened = _size() - F.col("left") - F.col("right")
    while not found or not lists.isEmpty():
        short, long = _by_size(lists, list_words)
        # With no letter open a list is one word and at most an alphabet of longer ones; with one open, at
        # most an alphabet of words of its length, which are paired here, and the longer ones are cut once more.
        ended = long.where(opened <= 0).unionByName(long.where((opened == 1) & ~F.col("long")))
        found.append(stored(_verified(short.unionByName(ended)), "spelling-pairs"))
        lists = stored(_cut(long.where(opened > 0)), "spelling-lists")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n, form, root, n_near, form_n``, one row for each word."""
    vocabulary = stored(words(docs, text), "spelling-words")
    pairs = stored(near_pairs(vocabulary), "spelling-near")
    both = pairs.select(F.col("x").alias("word"), F.col("nx").alias("n"), F.col("y").alias("other"), F.col("ny").alias("m")).union(
        pairs.select("y", "ny", "x", "nx")
    )
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= FORM_TIMES * F.col("n")
    near = stored(
        best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")),
        "spelling-forms",
    )
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(FORM_STEPS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return vocabulary.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
