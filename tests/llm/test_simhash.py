import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tabsight.llm import simhash

SPACE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in SPACE:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "A b\x0bC d", "é É ÀB c d e", "x " * 500])
def test_fingerprint_matches_the_definition(text):
    assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def test_blocks_of_hashes_give_the_same_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 97} v{i}" for i in range(500))
    want = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "HASH_BLOCK", 7)
    assert simhash.fingerprint_of(text) == want == brute_fingerprint(text)


def clustered(rng, n):
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_pairs_match_all_pairs(budget):
    keys = clustered(random.Random(budget), 300)
    left, right = keys[::2].copy(), keys[1::2].copy()
    for a, b, same in ((keys, keys, True), (left, right, False)):
        got = {(int(x), int(y)) for i, j in simhash.linked(a, b, same, budget) for x, y in zip(a[i], b[j])}
        want = {
            (int(x), int(y)) for x in a for y in b
            if bin(int(x) ^ int(y)).count("1") <= budget and (not same or x < y)
        }
        assert got == want


def test_frontier_pairs_cover_every_link():
    rng = random.Random(5)
    keys = clustered(rng, 400)
    depth = 10
    counts = {}
    for k in keys.tolist():
        counts[k >> (64 - depth)] = counts.get(k >> (64 - depth), 0) + 1
    nodes = simhash.frontier(counts, depth, 8)
    pairs = set(simhash.node_pairs(nodes, 2))
    assert sum(1 for _ in nodes) > 8

    def node(k):
        return next(i for i, (d, p) in enumerate(nodes) if k >> (64 - d) == p) if nodes[0][0] else 0

    for i, a in enumerate(keys.tolist()):
        for b in keys.tolist()[i:]:
            if bin(a ^ b).count("1") <= 2:
                assert tuple(sorted((node(a), node(b)))) in pairs


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    order = list(range(200))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_groups_on_the_documents(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(prints)
    got = simhash.near_groups(documents).select("*", simhash.fingerprint_text().alias("fp")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp for r in got} == {i: f"{p:016x}" for i, p in prints.items()}


def test_edge_cases(spark, table):
    docs = table([(3, None), (1, ""), (2, "  "), (5, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "x"), (9, "x")])
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == [("1", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 4), ("9", 9), ("9", 9), ("None", 4)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_small_nodes_give_the_same_components(spark, documents, monkeypatch):
    want = {tuple(r) for r in simhash.near_groups(documents).collect()}
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    keys = simhash.fingerprints(documents).select("bits").distinct()
    edges = simhash.links(keys, node_rows=8)
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    groups = {}
    for doc_id, bits, component in want:
        groups.setdefault(component, set()).add(bits)
    for bits in groups.values():
        assert len({labels.get(b, b) for b in bits}) == 1


def test_extra_columns_do_not_clash(spark, table):
    from pyspark.sql import functions as F

    docs = table([(1, "a b c"), (2, "a b c")])
    for name in ("bits", "label", "component_id", "norm", "kept"):
        docs = docs.withColumn(name, F.lit("x"))
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [1]


def test_of_rows_with_one_id_only_those_of_its_component_stay(table):
    docs = table([(0, "a b c d"), (1, "q r s t u v"), (1, "a b c d"), (1, "q r s t u v")])
    clash = docs.withColumns({c: F.lit(7) for c in ("__own", "__id", "__text_hash", "bits", "component_id", "text_hash")})
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "a b c d"), (1, "q r s t u v")]


@pytest.mark.parametrize("node_rows", [5, 40])
def test_nodes_with_one_long_prefix_are_cut_again(spark, node_rows):
    """Most fingerprints share their first 40 bits, far below the first frontier."""
    rng = random.Random(node_rows)
    keys = {(0xABCDEF1234 << 24) | rng.getrandbits(9) << rng.choice([0, 12]) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    keys |= {k ^ (1 << rng.randrange(64)) for k in list(keys)[:60]}
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    df = spark.createDataFrame([(k,) for k in signed], "bits long")
    depth = 8
    nodes = simhash._cut_nodes(df, node_rows, depth)
    held = [sum(k >> (64 - d) == p for k in keys) for d, p in nodes]
    assert sum(held) == len(keys) and max(held) <= node_rows

    def root(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(pairs):
        parent = {k: k for k in signed}
        for a, b in pairs:
            ra, rb = root(parent, a), root(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
        return {k: root(parent, k) for k in signed}

    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    got = [(r.a, r.b) for r in simhash.links(df, node_rows=node_rows).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in got)
    assert classes(got) == classes(near)
