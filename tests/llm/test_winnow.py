import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabsight.llm import winnow

MASK = (1 << 64) - 1


def rotl(x, n):
    n %= 64
    return ((x << n) | (x >> (64 - n))) & MASK if n else x


def brute(text, hashes, k=4, w=8):
    """(position, hash) of the chosen k-grams; ``hashes`` maps tokens to XXH64."""
    runs = re.findall(r"[^ \t\n\x0b\x0c\r]+", text.lower())
    tokens = [p for x in runs for p in ([x] if len(x) <= 32 else [x[i : i + 8] for i in range(len(x))])]
    if not tokens:
        return []
    grams = []
    for i in range(max(1, len(tokens) - k + 1)):
        value = 0
        for j in range(k):
            value = rotl(value, 1) ^ (hashes(tokens[i + j]) if i + j < len(tokens) else 0)
        grams.append(value)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        best = None
        for j in range(i, min(i + w, len(grams))):
            if best is None or grams[j] >> 31 <= grams[best] >> 31:
                best = j
        if (best, grams[best]) not in out:
            out.append((best, grams[best]))
    return out


def hashed(token):
    import xxhash

    return xxhash.xxh64(token.encode(), seed=42).intdigest()


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("k,w", [(4, 8), (1, 1), (5, 6)])
def test_fingerprints(spark, table, k, w):
    rng = random.Random(3)
    texts = ["", " ", "one", "A b", "a a a a a a a a a a a a a a", "x" * 100, "É ü 日本 " * 9]
    texts += [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(n)) for n in (4, 5, 11, 12, 40, 90)]
    docs = table(list(enumerate(texts)))
    for row in winnow.fingerprints(docs, k=k, window=w).collect():
        got = [(p, h & MASK) for p, h in zip(row.fp_pos, row.fp_hash)]
        assert got == brute(texts[row.doc_id], hashed, k, w)


def test_shared_runs_are_found(table):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(11)]
    texts = [" ".join([word() for _ in range(n)] + shared + [word() for _ in range(9)]) for n in (3, 17, 40)]
    rows = winnow.fingerprints(table(list(enumerate(texts)))).collect()
    sets = [set(r.fp_hash) for r in rows]
    assert sets[0] & sets[1] and sets[1] & sets[2] and sets[0] & sets[2]


def check(docs, rows):
    """Against the definition, for distinct ids."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    after = {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}
    got = {r.doc_id: r for r in winnow.summary(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        text, follow = text or "", after.get(doc_id, "")
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        one, two, three = brute(text, hashed), brute(edited, hashed), brute(follow, hashed)
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ",".join(f"{p}:{h:x}" for p, h in one)
        assert r.edited_fingerprint == ",".join(f"{p}:{h:x}" for p, h in two)
        assert r.near_edited == pytest.approx(jaccard(one, two))
        assert r.near_next == pytest.approx(jaccard(one, three))


def test_documents(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_sparse_and_missing_ids(table, monkeypatch):
    rng = random.Random(8)
    ids = rng.sample(range(-40_000, 40_000), 60) + [0, 127, 128, 129, -1, -128, -129, None]
    rows = [(i, f"text of {i} " * rng.randint(0, 9) if rng.random() > 0.1 else None) for i in ids]
    monkeypatch.setattr(winnow, "BLOCK_IDS", 3)
    monkeypatch.setattr(winnow, "GROUP_BLOCKS", 256)
    check(table(rows), rows)
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    check(table(rows), rows)


def test_edge_cases(table):
    assert winnow.summary(table([(1, "a")]).limit(0)).count() == 0
    check(table([(7, "only one text here é")]), [(7, "only one text here é")])
    docs = table([(1, "a b c d e f"), (1, "a b c d e f"), (0, "z")])
    for name in ("block", "next_text", "fp_hash", "edited", "key"):
        docs = docs.withColumn(name, F.lit("x"))
    rows = winnow.summary(docs).collect()
    assert len(rows) == 3 and len({r.fingerprint for r in rows if r.doc_id == 1}) == 1


def test_main_path_is_native(documents):
    plan = winnow.summary(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_shifted_passage_without_spaces_is_found(spark, table):
    rng = random.Random(12)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)] + ["é", "🙂", "a"]
    run = lambda n: "".join(rng.choice(signs) for _ in range(n))
    passage = run(1_000)
    short = passage[500:518]  # window + k + RUN_CHARS - 2 characters
    texts = [passage, "x" + passage, f"{run(77)}{short}{run(60)}", f"a b {run(40)}{short}{run(90)} c"]
    rows = {r.doc_id: r.fp_hash for r in winnow.fingerprints(table(list(enumerate(texts))), rolling=True).collect()}
    sets = [set(rows[i]) for i in range(4)]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.95
    assert sets[2] & sets[3] and sets[0] & sets[2] and sets[0] & sets[3]


def test_rolling_tokens(spark, table):
    rng = random.Random(13)
    space, texts = " \t\n\x0b\x0c\r", ["", " ", "One two", "x" * 32, "x" * 33, "Ab" * 20 + " end", "🙂é日" * 12, "a\u00a0b " + "日" * 40]
    texts += ["".join("".join(rng.choice("abé日🙂") for _ in range(rng.randint(1, 50))) + rng.choice(space) for _ in range(9)) for _ in range(60)]

    def plain(text):
        for run in re.findall(r"[^ \t\n\x0b\x0c\r]+", text.lower()):
            yield from [run] if len(run) <= 32 else [run[i : i + 8] for i in range(len(run))]

    for row in table(list(enumerate(texts))).select("doc_id", winnow.tokens(F.col("text"), True).alias("t")).collect():
        assert row.t == list(plain(texts[row.doc_id])), repr(texts[row.doc_id])


def test_the_query_finds_shifted_passages(spark, table, tmp_path):
    from tabsight.llm.queries import op1_fingerprints

    rng = random.Random(14)
    passage = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他") for _ in range(600))
    table([(2, passage), (1, "x" + passage)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    assert rows[2].near_next > 0.9


def test_very_long_texts_and_runs(table):
    """A long text of words, and one run without a space, which has a token at each character."""
    rows = [(1, "lorem ipsum dolor " * 3_000), (2, "x1y2z3" * 700), (3, None)]
    for row in winnow.fingerprints(table(rows)).collect():
        got = [(p, h & MASK) for p, h in zip(row.fp_pos, row.fp_hash)]
        assert got == brute(dict(rows)[row.doc_id] or "", hashed, 4, 8)
