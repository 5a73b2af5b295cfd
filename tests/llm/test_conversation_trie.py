import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tabsight.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string"


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    words = lambda t: len([w for w in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
    out = set()
    for node, convs in members.items():
        kids = [x for x in below[node] if len(x) == len(node) + 1]
        leaves = [x for x in below[node] if len(below[x]) == 1]
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in below[node] if x)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def got(df, rows, spark):
    out = [tuple(r) for r in ct.trie(ct.rebuild(df)).collect()]
    assert len(out) == len(set(out))
    return set(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


def test_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert got(df, rows, spark) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_trees(spark, seed, monkeypatch):
    """Short alphabets make many shared prefixes; small limits use the salts, hot parents and blocks."""
    monkeypatch.setattr(ct, "SALT_TURNS", 3)
    monkeypatch.setattr(ct, "HOT_CHILDREN", 3)
    monkeypatch.setattr(ct, "HOT_SHARE", 0.01)
    monkeypatch.setattr(ct, "BLOCK_BYTES", 20)
    rng = random.Random(seed)
    rows = []
    for c in range(-30, 160):
        if rng.random() < 0.2:
            continue
        for k in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", None, ""]), rng.choice(["a", "a b", "a\tb\x0bc d", None])))
    assert got(frame(spark, rows), rows, spark) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    """A third and more of all rows are one conversation, and most others are copies of each other."""
    rows = [(40, t, "user", f"t{t % 7} w") for t in range(400)]
    rows += [(c, t, "user", "same words here") for c in range(100, 220) for t in range(5)]
    assert got(frame(spark, rows), rows, spark) == brute(rows)


def test_edge_cases(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "a", "b"), (7, 1, "a", "b"), (8, 0, "u", "w " * 60_000), (21, 0, "u", "q")]
    assert got(frame(spark, rows), rows, spark) == brute(rows)
    assert ct.trie(ct.rebuild(frame(spark, rows).limit(0))).count() == 0
    # A conversation that is turnless once rebuilt: its own turns give way to a missing first conversation.
    lost = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(lost, 0, "u", "one")]
    assert got(frame(spark, rows, 1), rows, spark) == brute(rows) and len(brute(rows)) == 1


def test_roles_and_texts_are_told_apart(spark):
    rows = [(100, 0, "a", "bc"), (200, 0, "ab", "c"), (300, 0, "a", "bc")]
    assert got(frame(spark, rows), rows, spark) == brute(rows)
