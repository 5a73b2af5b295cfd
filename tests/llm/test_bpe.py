import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabsight.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "a", "don't we'll  x's5 'sabc", "tab\tnew\n\nline  end ", "日本語のテキスト、句読点。" * 30, "é́ ²5 ½x",
    "<|endoftext|> x", "🙂🙂 " * 40, "word" * 200, "1234567890" * 50, "a,b;c--d__e" * 40, "x   y z" * 30,
]


@pytest.mark.parametrize("size", [1, 2, 5, 17, 100])
def test_pieces_give_the_ids_of_the_whole_text(plain, size):
    for text in TEXTS:
        assert "".join(bpe.pieces(text, size)) == text
        assert list(bpe.encode_text(text, plain, size)) == plain.encode_ordinary(text)


def test_digests_and_round_trip(documents, plain):
    got = {r.doc_id: r for r in bpe.digests(documents, RANKS, P.PATTERN).collect()}
    for row in documents.collect():
        ids = plain.encode_ordinary(row.text)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_edge_cases(table):
    docs = table([(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (3, "x" * 100_000)]).withColumn("ids", F.lit(1))
    rows = bpe.encode(docs, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in rows) == [
        ("1", False), ("2", False), ("3", True), ("3", True), ("None", True),
    ]
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(len(r.decoded) for r in back) == [0, 0, 3, 100_000, 100_000]
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
