"""Toxicity by class-conditional Kneser-Ney models over characters.

Two interpolated Kneser-Ney models, one for toxic and one for ordinary labelled texts, score
every position of a text.  A log ratio within ``DEAD_ZONE`` nats is within the error of either model and
counts as equal.  The sum of the others over the square root of the length is the evidence: a
plain mean would drown a few expressions in a long text, a plain sum would grow with any text.
A one-variable logistic fit turns it into a probability.  Character n-grams see inflected
and compound forms of an expression that no word list holds.  Both models end in the same backoff: continuation
counts shared by the classes, so an expression that neither class has seen says nothing.

N-gram counts are summed by Spark; contexts, continuation counts and probabilities are DataFrame
aggregates and joins.  Every n-gram scores: up to ``PART_ENTRIES`` n-grams are one broadcast table; more
are cut into parts by their two middle codes, which all lookups of a position share, each part
passes over the texts alone, and the evidence of a row is summed over the parts.

Defined cases: an empty or missing text, or one of a single character, scores by its few or no positions (no position: the
prior of the calibration rows); rows without a label, or with labels for one class only, train nothing
(then every score is the prior); repeated label rows of a document count once; repeated
documents count each time; extra columns are kept by ``drop_toxic`` and ignored elsewhere; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored, unused, whole_text

ORDER = 4
CODE_BITS = 15
DISCOUNT = 0.75
DEAD_ZONE = 1.5
PART_ENTRIES = 4_000_000
BLOCK_CHARS = 1 << 17
BLOCK_ROWS = 256
CALIBRATION_ROWS = 50_000
BROADCAST_LABELS = 2_000_000


class Alphabet:
    """A code for each character of the training texts; 0 is any other character, white space and digits have one each.

    Characters beyond ``2 ** CODE_BITS - 4``, rarest last, share the last code; no script comes near that.
    """

    SPACE, DIGIT, FIRST = 1, 2, 3
    SPACES = [*range(9, 14), 32, 0x85, 0xA0]

    def __init__(self, points: list[int]):
        plain = [p for p in points if p not in self.SPACES and not 48 <= p < 58]
        self.points, self.table = np.array(plain, dtype=np.int64), None

    def __len__(self) -> int:
        return min(len(self.points) + self.FIRST, 1 << CODE_BITS)

    def __getstate__(self):
        return {"points": self.points, "table": None}

    def codes(self, points: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(0x110000, dtype=np.int64)
            self.table[self.points] = np.minimum(np.arange(len(self.points)) + self.FIRST, (1 << CODE_BITS) - 1)
            self.table[self.SPACES], self.table[48:58] = self.SPACE, self.DIGIT
        return self.table[points]


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)


def alphabet(rows: DataFrame) -> Alphabet:
    """The characters of all texts, most frequent first; at most one row a code point is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for held in _batches(t.lower() for t in batch.column("text").to_pylist()):
                points, n = np.unique(_points(held), return_counts=True)
                total[points] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["point", "n"])

    counted = rows.select("text").mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return Alphabet([r.point for r in sorted(counted.collect(), key=lambda r: (-r.n, r.point))])


def coded(texts: list[str], letters: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ORDER - 1 spaces, and the length of each text."""
    pad = " " * (ORDER - 1)
    lowered = [t.lower() for t in texts]
    return letters.codes(_points([pad + t for t in lowered])), np.array([len(t) for t in lowered], dtype=np.int64)


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Key of the last ``order`` codes at each position from the first complete one."""
    key = np.zeros(max(0, len(codes) - order + 1), dtype=np.int64)
    for i in range(order):
        key = key << CODE_BITS | codes[i : i + len(key)]
    return key


def _batches(texts: Iterator[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BLOCK_ROWS, so few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def gram_counts(rows: DataFrame, letters: Alphabet) -> DataFrame:
    """``gram, n0, n1`` over all rows of ``text, label``: counts at the highest order by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            texts = batch.column("text")
            for cls in (0, 1):
                for held in _batches(texts[i].as_py() for i, x in enumerate(labels) if x == cls):
                    codes, lengths = coded(held, letters)
                    inside = np.ones(len(codes), dtype=bool)
                    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
                    for k in range(ORDER - 1):
                        inside[starts + k] = False
                    key, n = np.unique(grams(codes, ORDER)[inside[ORDER - 1 :]], return_counts=True)
                    none = np.zeros(len(key), dtype=np.int64)
                    n = n.astype(np.int64)
                    both = [n, none] if cls == 0 else [none, n]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, both)], names=["gram", "n0", "n1"])

    counted = rows.select("text", "label").mapInArrow(run, "gram long, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def levels(counts: DataFrame, letters: int = 1 << CODE_BITS) -> dict[int, DataFrame]:
    """For each order 2..ORDER: ``gram, n, ratio, ctx, back``; log ratios toxic to ordinary.

    ``ratio`` is that of a seen n-gram, ``back`` what an unseen follower of its context adds.
    """
    mask = lambda k: F.lit((1 << (CODE_BITS * k)) - 1)
    seen = {ORDER: stored(counts, "kn-counts")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours, by class
        seen[k] = stored(
            seen[k + 1].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(
                F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"),
                F.count("*").alias("any"),
            ),
            "kn-counts",
        ).select("gram", "n0", "n1", *(["any"] if k == 1 else []))
    total = seen[1].agg(F.coalesce(F.sum("any"), F.lit(0)).alias("n")).first().n
    share = (F.col("any") + 0.5) / F.lit(float(total + 0.5 * letters))  # the shared backoff
    lower = seen[1].select("gram", share.alias("p0"), share.alias("p1"))
    out = {}
    for k in range(2, ORDER + 1):
        ctx = Window.partitionBy("ctx")
        rows = seen[k].withColumn("ctx", F.shiftrightunsigned("gram", CODE_BITS))
        for c in "01":
            rows = rows.withColumn(f"s{c}", F.sum(f"n{c}").over(ctx)).withColumn(f"t{c}", F.count_if(F.col(f"n{c}") > 0).over(ctx))
        suffix = lower.select(F.col("gram").alias("suffix"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(mask(k - 1))).join(suffix, "suffix")
        for c in "01":
            weight = F.when(F.col(f"s{c}") > 0, DISCOUNT * F.col(f"t{c}") / F.col(f"s{c}")).otherwise(1.0)
            own = F.when(F.col(f"n{c}") > 0, (F.col(f"n{c}") - DISCOUNT) / F.col(f"s{c}")).otherwise(0.0)
            rows = rows.withColumn(f"w{c}", weight).withColumn(f"p{c}", own + weight * F.col(f"q{c}"))
        done = stored(
            rows.select(
                "gram", "ctx", (F.col("n0") + F.col("n1")).alias("n"), "p0", "p1",
                F.log(F.col("p1") / F.col("p0")).alias("ratio"), F.log(F.col("w1") / F.col("w0")).alias("back"),
            ),
            "kn-level",
        )
        out[k], lower = done, done.select("gram", "p0", "p1")
    return out


def _place(key: np.ndarray, bits: int) -> np.ndarray:
    """Slot of a key by multiplicative hashing."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (-1: none) and values by slot, at most half full; a key stands in the first free slot from its own on."""
    bits = max(4, (2 * len(key)).bit_length())
    keys, values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.float32)
    left, slot = np.arange(len(key)), _place(key, bits)
    while len(left):
        free = keys[slot] < 0
        keys[slot[free]] = key[left[free]]
        done = keys[slot] == key[left]
        values[slot[done]] = value[left[done]]
        left, slot = left[~done], (slot[~done] + 1) & (len(keys) - 1)
    return keys, values


def _found(key: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    slot = _place(key, len(keys).bit_length() - 1)
    held = keys[slot]
    seen = held == key
    left = np.flatnonzero(~seen & (held >= 0))
    while len(left):
        slot[left] = (slot[left] + 1) & (len(keys) - 1)
        held = keys[slot[left]]
        hit = held == key[left]
        seen[left[hit]] = True
        left = left[~hit & (held >= 0)]
    return seen, values[slot]


class Part:
    """All n-grams whose middle codes lie in ``low <= third << CODE_BITS | second < high``."""

    def __init__(self, tables: dict, letters: Alphabet, low: int = 0, high: int = 1 << 2 * CODE_BITS):
        self.tables, self.letters, self.low, self.high = tables, letters, low, high

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Length-normalised log ratio of each text, toxic to ordinary, from the positions of this part."""
        out = []
        for held in _batches(iter(texts)):
            codes, lengths = coded(held, self.letters)
            ratios = np.concatenate(
                [self._ratios(codes[at : at + BLOCK_CHARS + ORDER - 1]) for at in range(0, max(1, len(codes) - ORDER + 1), BLOCK_CHARS)]
            )
            running = np.concatenate(([0.0], np.cumsum(ratios, dtype=np.float64)))
            ends = np.cumsum(lengths + ORDER - 1) - (ORDER - 1)
            out.append((running[ends] - running[ends - lengths]) / np.sqrt(np.maximum(lengths, 1)))
        return np.concatenate(out) if out else np.zeros(0)

    def _ratios(self, codes: np.ndarray) -> np.ndarray:
        """Log ratio at each position that has a complete context: longest seen n-gram plus backoff."""
        full = grams(codes, ORDER)
        if (self.low, self.high) == (0, 1 << 2 * CODE_BITS):
            return self._looked_up(full)
        one = (1 << CODE_BITS) - 1
        middle = (full >> CODE_BITS & one) << CODE_BITS | (full >> 2 * CODE_BITS & one)
        mine = np.flatnonzero((middle >= self.low) & (middle < self.high))
        out = np.zeros(len(full), dtype=np.float32)
        out[mine] = self._looked_up(full[mine])
        return out

    def _looked_up(self, full: np.ndarray) -> np.ndarray:
        ratio = np.zeros(len(full), dtype=np.float32)
        for k in range(2, ORDER + 1):
            key = full & ((1 << (CODE_BITS * k)) - 1)
            seen, value = _found(key, self.tables["ratio", k])
            known, back = _found(key >> CODE_BITS, self.tables["back", k])
            ratio = np.where(seen, value, ratio + np.where(known, back, np.float32(0)))
        return np.where(np.abs(ratio) > DEAD_ZONE, ratio, np.float32(0))


class Model:
    """Broadcast parts (none: nothing was learned) and calibration."""

    def __init__(self, parts: list, slope: float = 0.0, offset: float = 0.0):
        self.parts, self.slope, self.offset = parts, slope, offset

    def evidence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for part in self.parts:
            out += part.value.evidence(texts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.offset, -40, 40)))

    def score(self, evidence: Column) -> Column:
        line = F.least(F.greatest(F.lit(self.slope) * evidence + F.lit(self.offset), F.lit(-40.0)), F.lit(40.0))
        return 1.0 / (1.0 + F.exp(-line))


def _middle(gram: Column, behind: int) -> Column:
    """Third and second code of an n-gram or context that ends ``behind`` codes after the third."""
    one = F.lit((1 << CODE_BITS) - 1)
    third = F.shiftright(gram, CODE_BITS * behind).bitwiseAND(one)
    return F.shiftleft(third, CODE_BITS).bitwiseOR(F.shiftright(gram, CODE_BITS * (behind + 1)).bitwiseAND(one))


def _ranges(by_level: dict[int, DataFrame]) -> list[tuple[int, int]]:
    """Ranges of middle codes with about PART_ENTRIES n-grams each; none without n-grams.

    The cuts are quantiles of the pairs of middle codes, so one number a part is read.
    """
    total, end = sum(level.count() for level in by_level.values()), 1 << 2 * CODE_BITS
    if total <= PART_ENTRIES:
        return [(0, end)] if total else []
    middles = by_level[ORDER].select(_middle(F.col("gram"), 1).alias("middle"))
    for k in range(3, ORDER):
        middles = middles.union(by_level[k].select(_middle(F.col("gram"), 1)))
    parts = -(-total // PART_ENTRIES)
    places = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = middles.agg(F.percentile_approx("middle", places, 100_000).alias("cuts")).first().cuts
    cuts = sorted({0, *(found or [])})
    return list(zip(cuts, [*cuts[1:], end]))


def _parts(by_level: dict[int, DataFrame], letters: Alphabet) -> list:
    """Broadcasts of the parts; the driver holds the tables of one part at a time."""
    context = by_level[ORDER].sparkSession.sparkContext

    def table(rows: DataFrame, key: str, value: str, k: int, behind: int, low: int, high: int):
        if (low, high) != (0, 1 << 2 * CODE_BITS):
            # The shortest n-grams have no second code: a part holds those of all its third codes.
            first = low if k > 2 else low >> CODE_BITS << CODE_BITS
            middle = _middle(F.col(key), behind) if k > 2 else F.shiftleft(
                F.shiftright(key, CODE_BITS * behind).bitwiseAND(F.lit((1 << CODE_BITS) - 1)), CODE_BITS
            )
            rows = rows.where((middle >= first) & (middle < high))
        read = rows.select(F.col(key).alias("key"), F.col(value).cast("float").alias("value")).toArrow()
        return _hashed(read["key"].to_numpy(), read["value"].to_numpy())

    out = []
    for low, high in _ranges(by_level):
        tables = {}
        for k, level in by_level.items():
            tables["ratio", k] = table(level, "gram", "ratio", k, 1, low, high)
            contexts = level.groupBy("ctx").agg(F.first("back").alias("back"))
            tables["back", k] = table(contexts, "ctx", "back", k, 0, low, high)
        out.append(context.broadcast(Part(tables, letters, low, high)))
    return out


def _fit_line(x: np.ndarray, y: np.ndarray, rate: float | None = None) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit; both classes weigh the same, with a light ridge.

    Without a slope every score is ``rate``, by default the share of toxic rows.
    """
    if len(y) == 0:
        return 0.0, 0.0
    rate = (y.sum() + 0.5) / (len(y) + 1) if rate is None else rate
    each = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    spread = x.std()
    if spread == 0 or y.min() == y.max():
        return 0.0, float(np.log(rate / (1 - rate)))
    z = (x - x.mean()) / spread
    w = np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (each * (y - p)) - np.array([0.01 * w[0], 0])
        hessian = (design * (each * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([0.01, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / spread), float(w[1] - w[0] * x.mean() / spread)


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str = "text") -> DataFrame:
    """``doc_id, text, label`` of documents with a 0/1 label; a broadcast only under a counted bound."""
    flags = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    small = labels.count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(flags) if small else flags, "doc_id")


def calibration(rows: DataFrame, bound: int) -> tuple[DataFrame, float]:
    """About ``bound`` rows by a digest of their ids, and the share of toxic ones in all ``rows``.

    Toxic rows have the first half of the bound and what the others leave, so all count up to there.
    """
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zeros, ones = n.get(0, 0), n.get(1, 0)
    take = min(ones, max(bound // 2, bound - zeros))
    share = {1: take / max(1, ones), 0: min(1.0, (bound - take) / max(1, zeros))}
    digest = F.pmod(F.xxhash64("doc_id", F.lit("calibration row")), F.lit(1 << 30))
    limit = F.when(F.col("label") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    return rows.where(digest < limit), (ones + 0.5) / (ones + zeros + 1)


def train(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fit on ``doc_id, text, label``.

    One row in eight, by a hash of its id, is left out of a first model and calibrates its scores with about
    ``calibration_rows`` rows at most; then its n-grams are added, so the final counts have all rows.
    """
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(8)) == 0
    letters = alphabet(rows)
    counts = stored(gram_counts(rows.where(~apart), letters), "kn-counts")
    first = Model(_parts(levels(counts, len(letters)), letters))
    picked, rate = calibration(rows.where(apart), calibration_rows)
    held = evidence(picked.select("text", "label"), first).toArrow()
    x, y = held["evidence"].to_numpy(), held["label"].to_numpy().astype(float)
    slope, offset = _fit_line(x, y, rate)
    for part in first.parts:
        part.unpersist()
    both = counts.union(gram_counts(rows.where(apart), letters)).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return Model(_parts(levels(both, len(letters)), letters), max(slope, 0.0), offset)


def _summed(rows: DataFrame, model: Model, text: str) -> tuple[DataFrame, str]:
    """``rows`` with their evidence, and its column: one pass of the texts for each part, summed by row."""
    row, total = unused(rows, "row", "evidence_of_row")
    held = stored(rows.withColumn(row, F.monotonically_increasing_id()), "toxicity-rows")
    passes = None
    for part in model.parts:

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                found = part.value.evidence([t or "" for t in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(found)], names=[row, total])

        once = held.select(row, text).mapInArrow(run, f"{row} long, {total} double")
        passes = once if passes is None else passes.union(once)
    sums = stored(passes.groupBy(row).agg(F.sum(total).alias(total)), "toxicity-evidence")
    return held.join(sums, row).drop(row), total


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    if len(model.parts) > 1:
        summed, total = _summed(rows.select("text", "label"), model, "text")
        return summed.select("label", F.col(total).alias("evidence"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(model.evidence(texts))], names=["label", "evidence"]
            )

    return rows.mapInArrow(run, "label int, evidence double")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, score``, one row for each input row."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    if len(model.parts) > 1:
        summed, total = _summed(picked, model, "text")
        return summed.select("doc_id", model.score(F.col(total)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(texts))], names=["doc_id", "score"]
            )

    return picked.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with all their columns; no shuffle of texts for one part."""
    if len(model.parts) > 1:
        summed, total = _summed(docs, model, text)
        return summed.where(model.score(F.col(total)) < threshold).select(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
