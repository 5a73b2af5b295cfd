import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabsight.llm import spelling


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_pairs(vocabulary):
    """All pairs of words compared, but for lengths over one apart."""
    by_size = defaultdict(list)
    for w in sorted(vocabulary):
        by_size[len(w)].append(w)
    out = set()
    for size, short in by_size.items():
        for a in short:
            out |= {(a, b) for b in short if a < b and one_edit(a, b)}
            out |= {tuple(sorted((a, b))) for b in by_size.get(size + 1, []) if one_edit(a, b)}
    return out


def plain_variants(rows):
    vocabulary = plain_words(rows)
    near = defaultdict(list)
    for a, b in plain_pairs(vocabulary):
        near[a].append(b)
        near[b].append(a)
    forms = {}
    for w, n in vocabulary.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-vocabulary[x], x))
            if vocabulary[best] >= 10 * n:
                forms[w] = best
    out = set()
    for w, n in vocabulary.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, n, forms.get(w), root, len(near[w]), vocabulary[forms[w]] if w in forms else None))
    return out


def rows_of(df):
    return [(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()]


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = rows_of(spelling.variants(documents))
    want = plain_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[2] for r in want)


def pairs(spark, vocabulary, **options):
    df = spark.createDataFrame([(w, 2) for w in vocabulary], "word string, n long")
    got = [tuple(sorted((r.x, r.y))) for r in spelling.near_pairs(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("limit, longest, count", [(2, 4, 3), (128, 3, 64), (5, 6, 1)])
def test_all_pairs_whatever_the_dictionary(spark, limit, longest, count, monkeypatch):
    """Few letters make long lists and many near words; tiny limits cut the lists down to one open letter."""
    monkeypatch.setattr(spelling, "LONGEST", longest)
    monkeypatch.setattr(spelling, "GRAM_COUNT", count)
    rng = random.Random(limit)
    vocabulary = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(500)}
    vocabulary |= {w[:3] + c + w[3 + k :] for w in list(vocabulary)[:60] for c in "xy" for k in (0, 1)}
    assert pairs(spark, vocabulary, list_words=limit) == plain_pairs(vocabulary)


def test_hot_stem(spark, monkeypatch):
    """A third and more of all words share their first letters; very long lists are found by broadcast."""
    monkeypatch.setattr(spelling, "HOT_SHARE", 0.01)
    rng = random.Random(5)
    vocabulary = {"internation" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(250)}
    vocabulary |= {"".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(400)}
    assert pairs(spark, vocabulary, list_words=8) == plain_pairs(vocabulary)


@pytest.mark.parametrize("seed", range(4))
def test_bound_holds(seed):
    """The grams that an edit leaves alone are in the other word, at the same place or one further."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg"[: 3 + seed]) for _ in range(rng.randint(7, 14))) for _ in range(400)]
    counts = Counter(w[p : p + k] for w in words for k in range(2, 5) for p in range(len(w) - k + 1))
    index = spelling.GramIndex({g: n for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > 60})
    for _ in range(4_000):
        w = rng.choice(words)
        i, op, c = rng.randrange(len(w)), rng.randrange(3), rng.choice("abcdefgh")
        x = w[:i] + (c if op else "") + w[i + (op < 2) :]
        if len(x) < 7 or x == w:
            continue
        shift = len(x) - len(w)
        grams, other = index.decompose(w), set(index.decompose(x))
        kept = [(p, k) for p, k in grams if (p + k <= i and (p, k) in other) or (p >= i + (op < 2) and (p + shift, k) in other)]
        assert len(kept) >= len(grams) - index.touched(w, grams)


def test_edge_cases(table):
    rows = [(1, None), (2, ""), (None, "Internet internet"), (3, "internet " * 40_000), (3, "internet " * 40_000), (4, "a" * 50_000 + " " + "a" * 50_000)]
    rows += [(5, "internat internat ÉCOLIERE école×÷ Écoliere écoliere éCOLIERE zz"), (6, "INTERNET1internet_internett internett")]
    docs = table(rows).withColumns({"word": F.lit("w"), "n": F.lit(1)})
    assert set(rows_of(spelling.variants(docs))) == plain_variants(rows)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(table):
    texts = {"settinga": 2, "settingab": 30, "settingabc": 400, "settingabd": 400}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(texts.items(), start=50)]
    got = {r[0]: r for r in rows_of(spelling.variants(table(rows)))}
    assert set(got.values()) == plain_variants(rows)
