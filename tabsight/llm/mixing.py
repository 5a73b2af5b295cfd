"""Mixing to target weights by iterative proportional fitting.

Tokens are summed over cells of source, language and topic; the sums are raked to the target
shares of each margin, with inclusion probabilities held at 1 or less while raking, and every document is
drawn with the probability of its cell.  A category that no target names counts as ``*``, so
the number of cells is bounded by the targets and not by the corpus.  Draws are digests of the id, so
a recomputed partition draws the same documents.

Defined cases: a missing source or language is ``*``; a missing or empty text has no tokens and takes its
cell's probability; categories without tokens give their share to the others in proportion; a target
beyond a category's tokens takes all of them; a category with target 0 is never drawn, and where
that is ``*`` because the named shares leave nothing, a warning counts its tokens (none if the targets name ``*``); repeated rows share one draw; a missing ``doc_id`` draws by
its text; extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import whole_text

REST = "*"
MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Shares of all drawn tokens for each margin; ``*`` takes what the named ones leave."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    budget: float = 0.5  # share of all tokens to draw
    seed: int = 42
    sweeps: int = 200
    tolerance: float = 1e-9

    def names(self, margin: str) -> list[str]:
        return [*sorted(k for k in getattr(self, margin) if k != REST), REST]

    def shares(self, margin: str) -> np.ndarray:
        given = getattr(self, margin)
        named = [given[k] for k in self.names(margin)[:-1]]
        if min([0.0, *named]) < 0 or sum(named) > 1 + 1e-9:
            raise ValueError(f"shares of {margin} must be positive and sum to at most 1")
        return np.array([*named, max(0.0, 1.0 - sum(named))])


def topic_of(text: str = "text") -> Column:
    """A coarse topic from the text alone: legal notices, contact data, tables, other prose."""
    value = whole_text(text)
    return (
        F.when(value.contains("License") | value.contains("licensed"), "legal")
        .when(value.contains("@"), "contact")
        .when(value.contains(" | "), "table")
        .otherwise("prose")
    )


def token_count(text: str = "text") -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(whole_text(text), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _class(value: Column, names: list[str]) -> Column:
    return F.when(value.isin(names[:-1]), value).otherwise(F.lit(REST))


def _celled(docs: DataFrame, targets: Targets, topic: Column | None) -> DataFrame:
    """The documents with ``__source, __lang, __topic, __tokens``."""
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of() if topic is None else topic}
    return docs.select(
        "*", *[_class(values[m], targets.names(m)).alias(f"__{m}") for m in MARGINS], token_count().alias("__tokens")
    )


def rake(tokens: np.ndarray, targets: Targets) -> np.ndarray:
    """Inclusion probability of each cell of a (source, lang, topic) token table.

    Sweeps over the margins; within a category all probabilities are multiplied by the factor that
    meets the category's target with none above 1.
    """
    total = tokens.sum()
    probability = np.full(tokens.shape, min(1.0, targets.budget))
    if total <= 0:
        return probability
    goals = []
    for axis, margin in enumerate(MARGINS):
        others = tuple(i for i in range(3) if i != axis)
        share = np.where(tokens.sum(axis=others) > 0, targets.shares(margin), 0.0)
        if share.sum() > 0:
            goals.append((axis, share / share.sum() * targets.budget * total))
    for _ in range(targets.sweeps):
        before = probability.copy()
        for axis, goal in goals:
            for i, wanted in enumerate(goal):
                place = tuple(i if k == axis else slice(None) for k in range(3))
                probability[place] = _scaled(probability[place], tokens[place], wanted)
        if np.abs(probability - before).max() < targets.tolerance:
            break
    return probability


def _scaled(probability: np.ndarray, tokens: np.ndarray, wanted: float) -> np.ndarray:
    """Probabilities times one factor, cut at 1, that draw ``wanted`` tokens (or all there are)."""
    has = (tokens > 0) & (probability > 0)
    if wanted >= tokens[has].sum():
        return np.where(has, 1.0, probability)
    if wanted <= 0:
        return np.zeros_like(probability)
    # The expected tokens rise piecewise linearly with the factor; the cells are full in order of probability.
    p, n = probability[has], tokens[has]
    order = np.argsort(-p, kind="stable")
    p, n = p[order], n[order]
    full = np.concatenate(([0.0], np.cumsum(n)))[:-1]  # tokens of cells that are already at 1
    open_ = np.cumsum((p * n)[::-1])[::-1]
    factor = (wanted - full) / open_
    first = int(np.argmax(factor * p <= 1 + 1e-12))
    return np.minimum(1.0, probability * factor[first])


def cell_probabilities(celled: DataFrame, targets: Targets) -> list[tuple]:
    """(source, lang, topic, weight, probability) of every possible cell; at most one row a cell is read."""
    names = [targets.names(m) for m in MARGINS]
    place = [{n: i for i, n in enumerate(x)} for x in names]
    tokens = np.zeros([len(x) for x in names])
    sums = celled.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens")).collect()
    for row in sums:
        tokens[place[0][row[0]], place[1][row[1]], place[2][row[2]]] = row.tokens
    for axis, margin in enumerate(MARGINS):
        rest = tokens.take(-1, axis=axis).sum()
        if rest > 0 and targets.shares(margin)[-1] <= 1e-9 and getattr(targets, margin).get(REST) != 0:
            warnings.warn(f"{margin}: {rest:.0f} tokens of unnamed or missing values are never drawn; the named shares leave none")
    probability = rake(tokens, targets)
    return [
        (a, b, c, float(probability[i, j, k] / targets.budget), float(probability[i, j, k]))
        for i, a in enumerate(names[0]) for j, b in enumerate(names[1]) for k, c in enumerate(names[2])
    ]


def draw(seed: int) -> Column:
    """Uniform in [0, 1) from a digest of the id (of the text where the id is missing)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(whole_text().cast("binary")))
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{seed}")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def _weighted(docs: DataFrame, targets: Targets, topic: Column | None) -> DataFrame:
    celled = _celled(docs, targets, topic)
    table = docs.sparkSession.createDataFrame(
        cell_probabilities(celled, targets),
        "__source string, __lang string, __topic string, __weight double, __probability double",
    )
    return celled.join(F.broadcast(table), ["__source", "__lang", "__topic"]).withColumn("__draw", draw(targets.seed))


def mix(docs: DataFrame, targets: Targets, topic: Column | None = None) -> DataFrame:
    """One row for each input row: its cell, tokens, weight, probability, draw and whether it is drawn."""
    return _weighted(docs, targets, topic).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("__source").alias("source_class"), F.col("__lang").alias("lang_class"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"),
        F.col("__probability").alias("probability"), F.col("__draw").alias("draw"),
        (F.col("__draw") < F.col("__probability")).alias("selected"),
    )


def sample(docs: DataFrame, targets: Targets, topic: Column | None = None) -> DataFrame:
    """The drawn documents, with their columns, whatever these are called."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    needed = {c: F.col(place[c]) for c in ("doc_id", "text", "source", "lang")}
    if topic is not None:
        return _weighted(docs, targets, topic).where(F.col("__draw") < F.col("__probability")).select(*docs.columns)
    drawn = _weighted(numbered.withColumns(needed), targets, None).where(F.col("__draw") < F.col("__probability"))
    return drawn.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
