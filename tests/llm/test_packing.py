import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsight.llm import packing

VOCABULARY = P.path("byte_bpe_50k.json")
LATIN = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC)]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(VOCABULARY)

    def ids(text):
        got = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(got)}I", *got)

    return ids


def best_fit_decreasing(items, capacity):
    """Room left in each bin, piece by piece."""
    bins = []
    for length in sorted(items, reverse=True):
        open_bins = [(room, i) for i, room in enumerate(bins) if room >= length]
        if open_bins:
            bins[min(open_bins)[1]] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(150))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 24, 64])
    items = [rng.randint(1, capacity if seed % 3 else capacity // 3) for _ in range(rng.randint(0, 250))]
    counts, bins = Counter(items), defaultdict(list)
    slots = packing.Slots(packing.plan(counts, capacity))
    for length, n in counts.items():
        for sequence, offset in zip(*slots.find(np.full(n, length), np.arange(n))):
            bins[int(sequence)].append((int(offset), length))
    room = []
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        room.append(capacity - at)
    assert sorted(room) == best_fit_decreasing(items, capacity)


def test_plan_stays_small():
    rng = random.Random(0)
    assert len(packing.plan({n: rng.randint(1, 10**10) for n in range(1, 1025)})) < 10_000


def test_ids_are_those_of_the_library(plain):
    encoder = packing.Encoder(VOCABULARY)
    assert encoder.merges is not None
    for c in LATIN:
        for text in (c, f"a{c}b", f" {c}", f"1{c}2", f"{c}{c} ", f"! {c} x", f"{c}\n{c}", f"a {c}{c}a", f"'s{c}'ll", f"\n{c} a"):
            assert encoder.encode(text) == plain(text), repr(text)
    rng = random.Random(1)
    for k in range(3_000):
        text = "".join(rng.choice(LATIN if k % 2 else "ab'stlvred 1.\n\t\xa0éß  ,") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == plain(text), repr(text)
    for text in ("", "a <|endoftext|> b", "日本語 text", "  x", "<|endoftext|>", "x " * 40_000, "y" * 5_000):
        assert encoder.encode(text) == plain(text)


def test_other_vocabularies_use_the_library():
    word = packing.Encoder(P.path("word_bpe_49k.json"))
    assert word.merges is None
    assert word.encode("Hello") == struct.pack("<1I", *word.tokenizer.encode("Hello", add_special_tokens=False).ids)


def checked(rows, got, plain, capacity):
    """Every piece is where the contract wants it; sequences are gapless and within the capacity."""
    want = []
    for doc_id, text in rows:
        data = plain(text or "") + struct.pack("<I", 2)
        n = len(data) // 4
        k = -(-n // capacity)
        first = n - (k - 1) * capacity
        for piece in range(k):
            start = 0 if piece == 0 else first + (piece - 1) * capacity
            length = first if piece == 0 else capacity
            want.append((str(doc_id), piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    room = []
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
        room.append(capacity - at)
    assert sorted(room) == best_fit_decreasing([w[3] for w in want], capacity)


@pytest.mark.parametrize("broadcast", [0, 300_000])
def test_documents(documents, plain, broadcast, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", broadcast)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    docs = documents.repartition(5) if broadcast else documents
    checked(rows, packing.pack(docs, VOCABULARY).collect(), plain, 1024)


def test_edge_cases(table, plain):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w x " * 3_000), (3, "w x " * 3_000), (4, "é" * 50), *[(k, "same text") for k in range(5, 300)]]
    docs = table(rows).withColumns({"part": F.lit("p"), "length": F.lit(1), "ids": F.lit(2)}).repartition(4)
    got = packing.pack(docs, VOCABULARY, capacity=64)
    checked(rows, got.collect(), plain, 64)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(got).collect()}
    for r in got.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
