"""Language identification in two steps: the family, then the language within it.

A text is a vector of hashed letter n-grams (square roots of their shares, so its length does not
matter).  Linear support vector machines tell each family from the rest; within the chosen family
a machine for each pair of languages votes, margins break ties, then the name.  Spark fits the
machines on a bounded, documented sample of labelled rows; all machines are one matrix when predicting.

Defined cases: a missing text or one without a letter is ``und`` with score 0; labels that are missing train
nothing; a language of no known family is a family of its own; without any learned language every
text is ``und``; repeated rows and ids are predicted row by row; extra columns are ignored; an empty table
gives an empty table.  Every labelled language is learned, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored, whole_text

# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az kk uz ky tt tk".split(),
    "indic": "hi mr ne bn gu pa ur or as si".split(),
    "iranian": "fa ps ku tg".split(),
    "semitic": "ar he mt am".split(),
    "dravidian": "ta te kn ml".split(),
    "austronesian": "id ms tl jv mg".split(),
}
UNKNOWN = "und"
BUCKET_BITS = 11
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 600  # labelled rows of each language that the machines are fitted on
ROWS_AT_ONCE = 128


def family_of(language: str) -> str:
    base = language.lower().split("-")[0].split("_")[0]
    return next((f for f, members in FAMILIES.items() if base in members), f"own:{language}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed n-grams of letters; words are told apart by one space; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    codes = np.where(letter, points, 32).astype(np.uint64)
    space = codes == 32
    codes = np.concatenate(([32], codes[~(space & np.concatenate(([True], space[:-1])))], [32])).astype(np.uint64)
    counts = np.zeros(1 << BUCKET_BITS)
    key = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        key = key[: len(codes) - order + 1] * np.uint64(0x100000001B3) ^ codes[order - 1 :]
        if order in ORDERS and len(key):
            slot = ((key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
            counts += np.bincount(slot.astype(np.int64), minlength=1 << BUCKET_BITS)
    return np.sqrt(counts / counts.sum())


class Model:
    """Weights of all machines as one matrix; a machine is (kind, positive, negative)."""

    def __init__(self, languages: list[str], machines: list[tuple], weights: np.ndarray, offsets: np.ndarray):
        self.languages, self.machines, self.weights, self.offsets = languages, machines, weights, offsets
        self.families: dict[str, list[str]] = {}
        for language in sorted(languages):
            self.families.setdefault(family_of(language), []).append(language)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found = [features(t) for t in texts]
        have = [i for i, x in enumerate(found) if x is not None]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if have and self.languages:
            margins = np.stack([found[i] for i in have]) @ self.weights + self.offsets
            for i, row in zip(have, margins):
                names[i], scores[i] = self._choose(dict(zip(self.machines, row.tolist())))
        return names, scores

    def _choose(self, margin: dict) -> tuple[str, float]:
        families = sorted(self.families)
        by_family = {f: margin.get(("family", f, ""), 0.0) for f in families}
        family = max(families, key=lambda f: by_family[f])
        sure = 1.0 if len(families) == 1 else _squash(by_family[family])
        members = self.families[family]
        votes = {x: [0, 0.0] for x in members}
        for (kind, a, b), m in margin.items():
            if kind == "pair" and a in votes and b in votes:
                votes[a if m > 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(members, key=lambda x: votes[x])
        against = [m if a == best else -m for (kind, a, b), m in margin.items() if kind == "pair" and best in (a, b)]
        return best, sure * (_squash(min(against)) if against else 1.0)


def _squash(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(4.0 * margin, -40, 40))))


def _sample(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, list[str]]:
    """At most about SAMPLE_ROWS labelled rows of each language, by a digest of the id."""
    rows = docs.where(F.col(lang).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), whole_text(text).alias("text")
    )
    counts = rows.groupBy("lang").count().collect()  # a row a language
    share = {r.lang: int(min(1.0, SAMPLE_ROWS / r["count"]) * (1 << 30)) for r in counts}
    if not share:
        return rows, []
    cut = F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < cut), sorted(share)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", iterations: int = 25, strength: float = 1e-4) -> Model:
    """Fit on the rows of ``doc_id``, text and language."""
    sample, languages = _sample(docs, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            vectors = [features(t) for t in batch.column("text").to_pylist()]
            keep = [i for i, x in enumerate(vectors) if x is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(keep, type=pa.int64())),
                    pa.array([vectors[i].tolist() for i in keep], type=pa.list_(pa.float64())),
                ],
                names=["lang", "x"],
            )

    rows = stored(sample.select("lang", "text").mapInArrow(run, "lang string, x array<double>"), "langid-sample")
    rows = rows.select("lang", array_to_vector("x").alias("features"))
    languages = [x for x in languages if x in {r.lang for r in rows.select("lang").distinct().collect()}]
    model = Model(languages, [], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    tasks: list[tuple[tuple, Column, Column]] = []
    if len(model.families) > 1:
        for family, members in model.families.items():
            tasks.append((("family", family, ""), F.col("lang").isin(languages), F.col("lang").isin(members)))
    for members in model.families.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                tasks.append((("pair", a, b), F.col("lang").isin(a, b), F.col("lang") == a))
    columns, offsets = [], []
    for machine, which, positive in tasks:
        data = rows.where(which).withColumn("label", positive.cast("double"))
        fitted = LinearSVC(maxIter=iterations, regParam=strength, standardization=False).fit(data)
        model.machines.append(machine)
        columns.append(fitted.coefficients.toArray())
        offsets.append(fitted.intercept)
    if columns:
        model.weights, model.offsets = np.stack(columns, axis=1), np.array(offsets)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, one row for each input row; reads the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")
