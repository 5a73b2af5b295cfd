"""Trained operators: language, quality, toxicity; held-out accuracy and defined cases."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tabsight.llm import langid, quality_rules, toxicity

SYLLABLES = {
    "en": "th er on an re he in ed nd ha".split(), "de": "sch ein ich der ge ung ß ü ö ber".split(),
    "fr": "eau é è que ou aux oi tre ç la".split(), "xx": "qo zu ka wi mo tu".split(),
}


def prose(rng, language, words=60):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def speakers(table):
    rng = random.Random(1)
    return table([(i, prose(rng, lang, rng.randint(5, 80)), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 40)])


def test_language_families(speakers):
    model = langid.train(speakers)
    assert model.families == {"germanic": ["de", "en"], "romance": ["fr"], "own:xx": ["xx"]}
    rng = random.Random(2)
    for lang in SYLLABLES:
        names, scores = model.predict([prose(rng, lang) for _ in range(20)])
        assert names == [lang] * 20
        assert all(0 <= s <= 1 for s in scores)


def test_language_edge_cases(speakers, table):
    docs = table([(1, None), (2, ""), (3, "12 !?"), (4, "sch" * 40_000), (None, "é"), (4, "ich")]).withColumn("lang_pred", F.lit(1))
    model = langid.train(speakers)
    rows = langid.predict(docs, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und", r.score > 0) for r in rows) == [
        ("1", True, False), ("2", True, False), ("3", True, False), ("4", False, True), ("4", False, True), ("None", False, True),
    ]
    nothing = langid.train(speakers.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.train(speakers.where("lang = 'fr'"))
    assert one.predict(["abc"]) == (["fr"], [1.0])
    assert langid.predict(docs.limit(0), model).count() == 0


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(pairs)], "doc_id long, text string, label int")


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(400):
        words = prose(rng, "en", rng.randint(20, 150)).split()
        for k in range(0, len(words), 10) if i % 5 == 0 else ():
            words[k] = rng.choice(["vorgul", "vorgix", "vorgan"]) + rng.choice("abc")
        pairs.append((" ".join(words), int(i % 5 == 0)))
    return rows_of(spark, pairs)


def test_toxicity_separates_unseen_forms(rated):
    model = toxicity.train(rated)
    rng = random.Random(4)
    clean = [prose(rng, "en", 80) for _ in range(50)]
    toxic = [t + " vorgulz vorgixy vorganx vorgully vorgux " * 3 for t in clean]
    assert (model.scores(toxic) >= 0.5).mean() > 0.95
    assert (model.scores(clean) < 0.5).mean() > 0.95
    single = np.concatenate([model.scores([t]) for t in clean])
    assert np.allclose(single, model.scores(clean), atol=1e-5)


def test_long_texts_are_scored_in_blocks(rated, monkeypatch):
    model = toxicity.train(rated)
    text = [prose(random.Random(5), "en", 900), "", "a", "vorgula " * 50]
    want = model.scores(text)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 37)
    assert np.allclose(model.scores(text), want, atol=1e-5)


def plain_kneser_ney(rows):
    """Log ratio toxic to ordinary of a position, by dictionaries over characters."""
    pad, fold = " " * 3, lambda t: "".join(" " if c in " \t\n" else "0" if c in "0123456789" else c for c in t.lower())
    counts = {n: {} for n in (1, 2, 3, 4)}
    for text, y in rows:
        padded = pad + fold(text)
        for i in range(3, len(padded)):
            counts[4].setdefault(padded[i - 3 : i + 1], [0, 0])[y] += 1
    for n in (3, 2, 1):  # distinct left neighbours by class
        for gram, c in counts[n + 1].items():
            own = counts[n].setdefault(gram[1:], [0, 0])
            for y in (0, 1):
                own[y] += c[y] > 0
    left = {}
    for gram in counts[2]:
        left[gram[1]] = left.get(gram[1], 0) + 1
    letters = len({c for text, _ in rows for c in fold(text)} - {" ", "0"}) + 3
    total = sum(left.values())
    sums = {n: {} for n in (2, 3, 4)}
    for n in sums:
        for gram, c in counts[n].items():
            s = sums[n].setdefault(gram[:-1], [[0, 0], [0, 0]])
            for y in (0, 1):
                s[y][0] += c[y]
                s[y][1] += c[y] > 0

    def p(gram, y):
        if len(gram) == 1:
            return (left.get(gram, 0) + 0.5) / (total + 0.5 * letters)
        lower = p(gram[1:], y)
        n, kinds = sums[len(gram)].get(gram[:-1], [[0, 0], [0, 0]])[y]
        if n == 0:
            return lower
        c = counts[len(gram)].get(gram, [0, 0])[y]
        return max(c - 0.75, 0) / n + 0.75 * kinds / n * lower

    def evidence(text):
        padded, out = pad + fold(text), 0.0
        for i in range(3, len(padded)):
            ratio = math.log(p(padded[i - 3 : i + 1], 1) / p(padded[i - 3 : i + 1], 0))
            out += ratio if abs(ratio) > toxicity.DEAD_ZONE else 0.0
        return out / max(1, len(text)) ** 0.5

    return evidence


def test_evidence_matches_plain_kneser_ney(spark):
    """Characters of every plane keep their own codes; the second class shares its backoff."""
    rng = random.Random(9)
    letters = "abcdé日本語丁丂🙂🙃𠀀𠀁 0 7\t"
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))), int(i % 3 == 0)) for i in range(150)]
    known = toxicity.alphabet(rows_of(spark, rows))
    own = known.codes(toxicity._points(list("日本語丁丂🙂🙃𠀀𠀁é")))
    assert len(set(own.tolist())) == 10 and (own >= 3).all()
    counts = toxicity.gram_counts(rows_of(spark, rows), known)
    model = toxicity.Model(toxicity._parts(toxicity.levels(counts, len(known)), known))
    plain = plain_kneser_ney(rows)
    texts = [t for t, _ in rows[:40]] + ["日本語 🙂 丂丁" * 5, "never seen ü", ""]
    assert np.allclose(model.evidence(texts), [plain(t) for t in texts], atol=1e-4)


def test_probabilities_sum_to_one(rated):
    """The seen followers of a context never take more than the whole mass of a class."""
    levels = toxicity.levels(toxicity.gram_counts(rated, toxicity.alphabet(rated)))
    top = levels[2].toPandas()
    for _, group in top.groupby("ctx"):
        assert group.p0.sum() <= 1 + 1e-9 and group.p1.sum() <= 1 + 1e-9


def test_toxicity_edge_cases(spark, table, rated):
    model = toxicity.train(rated)
    docs = table([(1, None), (2, ""), (None, "vorgula"), (3, "x" * 100_000), (3, "x")]).withColumn("score", F.lit("s"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert 1 in {r.doc_id for r in kept.collect()}
    for pairs in ([], [("abc", 0)], [("abc def", 1), ("abc", 1)]):
        prior = toxicity.train(rows_of(spark, pairs))
        assert {round(float(s), 6) for s in prior.scores(["", "abc"])} != set()
    assert toxicity.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.label) for r in toxicity.labelled(docs, labels, "toxic").collect()] == [(2, 1)]


def test_quality_rules(spark, table):
    rng = random.Random(6)
    pairs = []
    for i in range(300):
        text = prose(rng, "en", rng.randint(20, 120))
        pairs.append((text if i % 4 else text.upper().replace(" ", "!! "), int(i % 4 > 0)))
    model = quality_rules.train(rows_of(spark, pairs).select("text", F.col("label").cast("double").alias("label")), trees=4)
    assert 0 < len(model.rules) < 60
    docs = table([(1, prose(rng, "en", 50)), (2, prose(rng, "en", 50).upper().replace(" ", "!! ")), (3, None), (4, ""), (None, "a b")])
    docs = docs.withColumn("s_upper", F.lit("x")).withColumn("score", F.lit("x"))
    scores = {r.doc_id: r.score for r in quality_rules.score(docs, model).collect()}
    assert scores[1] > 0.7 and scores[2] < 0.3 and scores[3] == scores[4] and len(scores) == 5
    plan = quality_rules.score(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_without_labels(spark, table):
    empty = spark.createDataFrame([], "text string, label double")
    assert quality_rules.score(table([(1, "a")]), quality_rules.train(empty)).first().score == 0.5
    ones = spark.createDataFrame([("a", 1.0)] * 3, "text string, label double")
    assert quality_rules.score(table([(1, "a")]), quality_rules.train(ones)).first().score > 0.8


def test_every_gram_scores_in_one_table_and_in_parts(spark, table, rated, monkeypatch):
    """The tables hold each n-gram of the levels, and parts give the scores of the whole."""
    docs = table([(i, t) for i, t in enumerate([None, "", "vorgula " * 9, prose(random.Random(8), "en", 90)])] + [(3, "vorgixc")])
    letters = toxicity.alphabet(rated)
    by_level = toxicity.levels(toxicity.gram_counts(rated, letters))
    whole = toxicity.Model(toxicity._parts(by_level, letters), 1.0, -1.0)
    for k, level in by_level.items():
        rows = level.select("gram", "ratio").toArrow()
        seen, value = toxicity._found(rows["gram"].to_numpy(), whole.parts[0].value.tables["ratio", k])
        assert seen.all() and np.allclose(value, rows["ratio"].to_numpy(), atol=1e-5)
    want = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, whole).collect())
    kept = sorted(map(str, toxicity.drop_toxic(docs, whole).collect()))
    monkeypatch.setattr(toxicity, "PART_ENTRIES", 300)
    cut = toxicity.Model(toxicity._parts(by_level, letters), 1.0, -1.0)
    assert len(cut.parts) > 3
    assert sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, cut).collect()) == want
    assert sorted(map(str, toxicity.drop_toxic(docs, cut).collect())) == kept


def test_colliding_grams_keep_their_values():
    key = np.random.default_rng(1).choice(1 << 48, 300_000, replace=False).astype(np.int64)
    table = toxicity._hashed(key[:200_000], np.arange(200_000, dtype=np.float32))
    seen, value = toxicity._found(key, table)
    assert seen[:200_000].all() and not seen[200_000:].any()
    assert (value[:200_000] == np.arange(200_000)).all()


def test_calibration_rows_come_from_the_whole_table(spark):
    """A head of ordinary rows only, as a table written by source has it, does not hide the toxic ones."""
    rows = spark.range(4_000).selectExpr("id AS doc_id", "'t' AS text", "int(id >= 3900) AS label").coalesce(1)
    picked, rate = toxicity.calibration(rows, 400)
    n = {r.label: r["count"] for r in picked.groupBy("label").count().collect()}
    assert n[1] == 100 and 200 < n[0] < 400
    assert picked.where("label = 0").agg(F.max("doc_id")).first()[0] > 3_000
    assert rate == pytest.approx(100.5 / 4_001)


def test_calibration_rows_are_learned_too(spark, rated, monkeypatch):
    """The n-grams of every labelled row are in the final model, and a sorted table is calibrated."""
    seen = []
    levels = toxicity.levels
    monkeypatch.setattr(toxicity, "levels", lambda counts, n: seen.append(counts) or levels(counts, n))
    model = toxicity.train(rated.orderBy("label").coalesce(1), calibration_rows=20)
    assert model.slope > 0
    want = sorted(map(tuple, toxicity.gram_counts(rated, toxicity.alphabet(rated)).collect()))
    assert sorted(map(tuple, seen[-1].collect())) == want


def plain_language(model, text):
    """Language and score by dictionaries and loops: hashed n-grams, margins, family, votes."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    if not letters.strip():
        return "und", 0.0
    line = " " + regex.sub(" +", " ", letters).lstrip(" ") + " "
    counts, whole = {}, 1 << 64
    for order in langid.ORDERS:
        for i in range(len(line) - order + 1):
            key = 0
            for c in line[i : i + order]:
                key = key * 0x100000001B3 % whole ^ ord(c)
            slot = (key + order) * 0x9E3779B97F4A7C15 % whole >> 64 - langid.BUCKET_BITS
            counts[slot] = counts.get(slot, 0) + 1
    total = sum(counts.values())
    margin = {
        m: model.offsets[j] + sum(model.weights[slot, j] * math.sqrt(n / total) for slot, n in counts.items())
        for j, m in enumerate(model.machines)
    }
    sigmoid = lambda x: 1 / (1 + math.exp(-4 * x))
    families = sorted({langid.family_of(x) for x in model.languages})
    family = max(families, key=lambda f: margin["family", f, ""])
    members = sorted(x for x in model.languages if langid.family_of(x) == family)

    def against(x):
        return [m if x == pair[1] else -m for pair, m in margin.items() if pair[0] == "pair" and x in pair[1:]]

    best = max(members, key=lambda x: (sum(m > 0 for m in against(x)), sum(against(x))))
    sure = sigmoid(margin["family", family, ""])
    return best, sure * (sigmoid(min(against(best))) if len(members) > 1 else 1.0)


def test_language_matches_plain_votes(table):
    rng = random.Random(21)
    ways = {**SYLLABLES, "nl": "ij aa oe ui cht van".split(), "es": "ñ os ción ll que".split(), "it": "gli zz cch io à".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(ways[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    model = langid.train(table([(i, text(lang, rng.randint(3, 40)), lang, "s") for i, lang in enumerate(list(ways) * 25)]))
    assert sorted(len(m) for m in model.families.values()) == [1, 3, 3]
    texts = [text(lang, n) for lang in ways for n in (1, 4, 30)]
    texts += [text("de", 5) + " 12-3 " + text("es", 5), "", " 7 ", "日本語 abc", "Ü", "a" * 3000]
    rows = langid.predict(table([(i, t, None, "s") for i, t in enumerate(texts)]), model).collect()
    assert len({r.lang_pred for r in rows}) == 8
    for r in rows:
        name, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == name and abs(r.score - score) < 1e-9


def plain_statistics(text):
    words, lines, n = regex.findall(r"[^ \t-\r]+", text.lower()), text.split("\n"), len(text)
    w, d = len(words), len(set(words))
    share = lambda a, b: a / b if b else 0.0
    count = lambda pattern: len(regex.findall(pattern, text))
    return {
        "log_words": math.log1p(w), "word_length": share(n - w, w), "upper": share(count(r"\p{Lu}"), n), "digits": share(count("[0-9]"), n),
        "symbols": share(count(r"[^\p{L}\p{N} \t-\r.,;:'\"()?!\-]"), n), "stops": share(count("[.?!]"), w), "lines": share(len(lines), w),
        "distinct_words": share(d, w), "distinct_lines": len(set(lines)) / len(lines), "wide": share(len(text.encode()) - n, n),
        "marks_after_word": share(count(r"[^\p{L}\p{N} \t-\r.,]{2,}(?=[ \t-\r]|$)"), w), "top_words": (w - d) / (w + 1.0) ** 1.1,
    }


def test_quality_matches_plain_rule_sums(table):
    """Statistics, rules and scores against loops; nulls, empty and very long texts, repeated ids and no rows too."""
    rng = random.Random(31)
    words = ["alpha", "Beta", "GAMMA", "été", "42", "日本", "$$$", "end.", "why?!", "##", "x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    label = [int(t.count("$") + t.count("#") > 0.06 * len(t)) for t in texts]
    data = table([(i, t, None, "s") for i, t in enumerate(texts)])
    marks = data.sparkSession.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    model = quality_rules.train(quality_rules.labelled(data, marks, "quality"))
    assert len(model.rules) > 3 and any(len(r.bounds) > 1 for r in model.rules)
    more = texts[:60] + [None, "", " \n ", "GAMMA## " * 40_000, "é" * 100_000, texts[0]]
    docs = table([(i % 62, t, None, "s") for i, t in enumerate(more)]).withColumn("score", F.lit("x")).withColumn("s_upper", F.lit(9))
    want = []
    for i, t in enumerate(more):
        found = plain_statistics(t or "")
        total = model.offset + sum(r.weight for r in model.rules if all(low < found[k] <= high for k, low, high in r.bounds))
        want.append((i % 62, 1 / (1 + math.exp(-total))))
    got = sorted(tuple(r) for r in quality_rules.score(docs, model).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([x for _, x in got], [x for _, x in sorted(want)], atol=1e-9)
    assert quality_rules.score(docs.limit(0), model).count() == 0
