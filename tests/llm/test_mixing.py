import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import mixing

TARGETS = mixing.Targets(
    source={"src0": 0.2, "src1": 0.3}, lang={"en": 0.5, "fr": 0.5}, topic={"prose": 0.8, "table": 0.2}, budget=0.3
)


def test_raking_meets_every_margin():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1_000, 9_000, size=(3, 3, 3)).astype(float)
    tokens[:, 2, :] = 0
    tokens[:, :, 1] = 0  # the classes * of language and the one of topic are named in sorted order
    targets = mixing.Targets(TARGETS.source, TARGETS.lang, TARGETS.topic, budget=0.15)  # within what every cell holds
    p = mixing.rake(tokens, targets)
    assert ((p >= 0) & (p <= 1)).all()
    drawn = tokens * p
    goal = 0.15 * tokens.sum()
    assert drawn.sum() == pytest.approx(goal, rel=1e-6)
    assert drawn.sum(axis=(1, 2)) == pytest.approx(np.array([0.2, 0.3, 0.5]) * goal, rel=1e-6)
    assert drawn.sum(axis=(0, 2)) == pytest.approx(np.array([0.5, 0.5, 0.0]) * goal, rel=1e-6)


def test_plain_fitting_agrees_where_no_probability_is_cut():
    rng = np.random.default_rng(2)
    tokens = rng.integers(5_000, 6_000, size=(3, 3, 3)).astype(float)
    targets = mixing.Targets(source={"a": 0.3, "b": 0.3}, lang={"x": 0.3, "y": 0.4}, topic={"t": 0.3, "u": 0.3}, budget=0.2)
    weight = np.ones_like(tokens)
    for _ in range(500):  # textbook iterative proportional fitting
        for axis, margin in enumerate(mixing.MARGINS):
            others = tuple(i for i in range(3) if i != axis)
            factor = targets.shares(margin) * tokens.sum() / (tokens * weight).sum(axis=others)
            weight = weight * np.expand_dims(factor, others)
    assert mixing.rake(tokens, targets) == pytest.approx(weight * 0.2, rel=1e-6)


def test_short_categories_give_all_they_have():
    tokens = np.zeros((2, 1, 1))
    tokens[:, 0, 0] = [10, 990]
    p = mixing.rake(tokens, mixing.Targets(source={"a": 0.9}, lang={}, topic={}, budget=0.5))
    assert p[0, 0, 0] == 1.0 and 0 < p[1, 0, 0] <= 1
    with pytest.raises(ValueError):
        mixing.Targets(source={"a": 0.9, "b": 0.9}, lang={}, topic={}).shares("source")


def brute(rows, targets):
    def topic(text):
        text = text or ""
        if "License" in text or "licensed" in text:
            return "legal"
        return "contact" if "@" in text else "table" if " | " in text else "prose"

    def named(value, margin):
        return value if value in getattr(targets, margin) else "*"

    cells = {}
    out = []
    for doc_id, text, lang, source in rows:
        cell = (named(source, "source"), named(lang, "lang"), named(topic(text), "topic"))
        n = len([w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()])
        cells[cell] = cells.get(cell, 0) + n
        key = str(doc_id) if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
        out.append((doc_id, cell, n, int(hashlib.md5(f"{key}#{targets.seed}".encode()).hexdigest()[:13], 16) / 16**13))
    names = [targets.names(m) for m in mixing.MARGINS]
    tokens = np.array([[[float(cells.get((a, b, c), 0)) for c in names[2]] for b in names[1]] for a in names[0]])
    p = mixing.rake(tokens, targets)
    return {
        (doc_id, cell, n, round(u, 9), u < p[tuple(names[i].index(cell[i]) for i in range(3))]) for doc_id, cell, n, u in out
    }


def got(df):
    return {
        (r.doc_id, (r.source_class, r.lang_class, r.topic), r.n_tokens, round(r.draw, 9), r.selected) for r in df.collect()
    }


def test_documents(documents):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]
    assert got(mixing.mix(documents, TARGETS)) == brute(rows, TARGETS)
    kept = mixing.sample(documents, TARGETS)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {x[0] for x in brute(rows, TARGETS) if x[-1]}


def test_edge_cases(table):
    rows = [(1, None, None, None), (2, "", "en", "src0"), (None, "a | b", "fr", "src1"), (3, "a\x0bb @", "en", "src0"), (4, "x " * 50_000, "de", "q")]
    docs = table(rows)
    clash = docs
    for name in ("topic", "weight", "draw", "n_tokens"):
        clash = clash.withColumn(name, F.lit("x"))
    assert got(mixing.mix(clash, TARGETS)) == brute(rows, TARGETS)
    assert mixing.sample(clash, TARGETS).columns == clash.columns
    assert mixing.mix(docs.limit(0), TARGETS).count() == 0


def test_missing_and_unseen_categories_can_be_drawn(table):
    from tabsight.llm.queries import MIX

    rows = [(i, "a few words " * 9, lang, source) for i, (lang, source) in enumerate(
        [("en", "src0"), ("de", "src1"), (None, "src0"), ("en", None), ("ja", "src3"), ("en", "new"), (None, None)] * 20
    )]
    rows += [(1_000, "", None, "src0"), (1_001, None, "en", "new")]
    got = mixing.mix(table(rows), MIX).collect()
    assert len(got) == len(rows) and min(r.probability for r in got) > 0
    assert {r.lang_class for r in got if r.selected} >= {"*"} and {r.source_class for r in got if r.selected} >= {"*"}


def test_named_shares_are_the_same_where_nothing_is_unnamed(documents):
    from tabsight.llm.queries import MIX

    full = mixing.Targets({f"src{i}": 0.05 for i in range(20)}, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, MIX.topic)
    rest = mixing.cell_probabilities(mixing._celled(documents, MIX, None), MIX)
    whole = mixing.cell_probabilities(mixing._celled(documents, full, None), full)
    assert [r[:3] for r in rest] == [r[:3] for r in whole]
    named = lambda rows: [r[4] for r in rows if "*" not in r[:3]]
    assert named(rest) == pytest.approx(named(whole), abs=1e-9)


def test_a_rest_without_a_share_is_told(table):
    docs = table([(1, "a b", "en", "src0"), (2, "c d", "en", "other")])
    lang, topic = {"en": 1.0}, {"prose": 1.0}
    with pytest.warns(UserWarning, match="source: 2 tokens"):
        mixing.mix(docs, mixing.Targets({"src0": 1.0}, lang, topic))
    left_out = mixing.mix(docs, mixing.Targets({"src0": 1.0, "*": 0.0}, lang, topic)).collect()
    assert [r.probability for r in sorted(left_out, key=lambda r: r.doc_id)] == [1.0, 0.0]
