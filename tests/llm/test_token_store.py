import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsight.llm import token_store

VOCABULARY = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_word_by_word_gives_the_ids_of_the_whole_text(plain):
    rng = random.Random(6)
    parts = [
        "Word", "don't", "it's,", "a.", "end.\n", "é,", "É.", "naïve", "ﬁ", "İ", "ΣΑΣ", "x²", "12", "...", ",,", "a,,", "ß", "ÀÉ",
        "日本語", "🙂", " ", "́", "é", " ", "\x1c", "\x85", " ", "  ", "\t", "\n", "'S", "K", "<|endoftext|>", "×÷",
    ]
    texts = ["", " "] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    encoder = token_store.WordEncoder(VOCABULARY, memory=50)
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encoder.ids(texts[at : at + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


def test_round_trip(documents, plain, tmp_path, spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 3000)
    path = str(tmp_path / "ids")
    token_store.write(documents, path, VOCABULARY, partitions=5)
    got = {r.doc_id: r for r in token_store.read(spark, path).collect()}
    start = 0
    for row in documents.orderBy("doc_id").collect():
        ids = plain(row.text) + [2]
        r = got[row.doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert token_store.read_one(spark, path, 7).tolist() == plain(documents.where("doc_id = 7").first().text) + [2]
    with pytest.raises(KeyError):
        token_store.read_one(spark, path, -1)
    plain_size = sum(4 * r.n_tokens for r in got.values())
    stored_size = sum(len(r.payload) for r in spark.read.parquet(f"{path}/blocks").collect())
    assert stored_size < plain_size / 2


def test_edge_cases(table, spark):
    docs = table([(5, None), (3, ""), (None, "a b"), (4, "x" * 60_000), (4, "x y"), (4, "x y")]).withColumn("ids", F.lit(1))
    rows = sorted(token_store.round_trip(docs, VOCABULARY).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 3, 4, 4, 4, 5]
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])))[:-1].tolist()
    assert rows[1].n_tokens == rows[-1].n_tokens == 1
    assert zlib.crc32(rows[1].ids) == zlib.crc32((2).to_bytes(4, "little"))
    assert token_store.round_trip(docs.limit(0), VOCABULARY).count() == 0


def test_added_tokens_have_their_ids(table):
    """Against the library as it comes, with no setting changed."""
    library = Tokenizer.from_file(VOCABULARY)
    texts = [
        "end of file <|endoftext|> next", "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|> c.", "<|ENDOFTEXT|> x", "<|endoftext|",
        "e<|endoftext|>\u0301", "It<|endoftext|>'s", "<|<|endoftext|>|>", "plain",
    ]
    rng = random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "Word", "don't", "É.", " ", "\n", "\u0301", "12", "日本"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(300)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.round_trip(table(list(enumerate(texts))), VOCABULARY).collect()}
    for i, text in enumerate(texts):
        assert got[i] == library.encode(text, add_special_tokens=False).ids + [2], repr(text)
