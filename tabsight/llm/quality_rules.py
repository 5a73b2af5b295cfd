"""Quality by a sparse rule ensemble that runs as Spark column expressions.

Statistics of a text are built-in functions.  A small forest on labelled rows yields its
paths as conjunctive rules, a lasso logistic fit weighs them and drops most, and the
rest become one column expression: scoring is a scan without Python and without a shuffle.

The forest and the lasso see at most about ``FIT_ROWS`` labelled rows, picked by a digest; the
statistics and the score cover whole texts of all documents.

Defined cases: a missing text is empty; an empty text has statistics of zero and is scored like any
other; without labels, or with one class only, every score is the share of label 1 (0.5 without
any); repeated label rows count once, the higher label wins; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored, whole_text

FIT_ROWS = 20_000
TREES = 12
DEPTH = 4
LASSO = 0.002
SEED = 7
BROADCAST_LABELS = 2_000_000

# Statistics by name; each is a share or a mean, so long and short texts compare.
STATISTICS = (
    "log_words", "word_length", "upper", "digits", "symbols", "stops", "lines", "distinct_words", "distinct_lines",
    "wide", "marks_after_word", "top_words",
)


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """Adds ``s_<name>`` columns."""
    count = lambda pattern: F.regexp_count(F.col(text), F.lit(pattern))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    df = df.withColumns({"__words": F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), "__lines": F.split(text, "\n", -1)})
    df = df.withColumns(
        {"__n": F.length(text), "__w": F.size("__words"), "__l": F.size("__lines"), "__d": F.size(F.array_distinct("__words"))}
    )
    n, w, lines = F.col("__n"), F.col("__w"), F.col("__l")
    return df.withColumns(
        {
            "s_log_words": F.log1p(w), "s_word_length": share(n - w, w), "s_upper": share(count(r"\p{Lu}"), n),
            "s_digits": share(count("[0-9]"), n), "s_symbols": share(count(r"[^\p{L}\p{N}\s.,;:'\"()?!-]"), n),
            "s_stops": share(count("[.?!]"), w), "s_lines": share(lines, w), "s_distinct_words": share(F.col("__d"), w),
            "s_distinct_lines": share(F.size(F.array_distinct("__lines")), lines), "s_wide": share(F.octet_length(text) - n, n),
            "s_marks_after_word": share(count(r"[^\p{L}\p{N}\s.,]{2,}(?=\s|$)"), w),
            # Words a hundred that a text of this length repeats beyond what its distinct words explain.
            "s_top_words": share(w - F.col("__d"), F.pow(w + 1.0, F.lit(1.1))),
        }
    ).drop("__words", "__lines", "__n", "__w", "__l", "__d")


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds on statistics: low < value <= high, by name."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(f"s_{name}")
            if low > -math.inf:
                out = out & (value > low)
            if high < math.inf:
                out = out & (value <= high)
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    offset: float

    def score(self) -> Column:
        """Probability of label 1 from the statistics columns."""
        total = F.lit(self.offset)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, bounds: dict) -> list[tuple]:
    """Bounds of every node below the root of a fitted tree."""
    out = [tuple(sorted((k, *v) for k, v in bounds.items()))] if bounds else []
    if node.getClass().getSimpleName() != "InternalNode":
        return out
    name, cut = STATISTICS[node.split().featureIndex()], node.split().threshold()
    low, high = bounds.get(name, (-math.inf, math.inf))
    out += _paths(node.leftChild(), {**bounds, name: (low, min(high, cut))})
    return out + _paths(node.rightChild(), {**bounds, name: (max(low, cut), high)})


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """``text, label`` of about ``rows`` labelled documents; a broadcast only under a counted bound."""
    flags = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(F.col(label).cast("double")).alias("label"))
    n = labels.count()
    cut = int(min(1.0, rows / max(1, n)) * (1 << 30))
    flags = flags.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return wide.join(F.broadcast(flags) if min(n, 2 * rows) <= BROADCAST_LABELS else flags, "doc_id").select("text", "label")


def train(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """Fit on ``text, label``."""
    table = stored(with_statistics(rows, "text").drop("text"), "quality-rows")
    totals = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    if totals.n == 0 or totals.ones in (0, totals.n):
        rate = (totals.ones + 0.5) / (totals.n + 1)
        return Model((), math.log(rate / (1 - rate)))
    plain = F.array(*[F.col(f"s_{s}").cast("double") for s in STATISTICS])
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64
    ).fit(table.select("label", array_to_vector(plain).alias("features")))
    seen = sorted({path for tree in forest.trees for path in _paths(tree._call_java("rootNode"), {})})
    rules = [Rule(path) for path in seen]
    if not rules:
        rate = totals.ones / totals.n
        return Model((), math.log(rate / (1 - rate)))
    fired = F.array(*[r.column().cast("double") for r in rules])
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100, standardization=False).fit(
        table.select("label", array_to_vector(fired).alias("features"))
    )
    weights = fit.coefficients.toArray()
    return Model(tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights) if w != 0.0), float(fit.intercept))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, score``, one row for each input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return with_statistics(rows, "text").select("doc_id", model.score().alias("score"))
