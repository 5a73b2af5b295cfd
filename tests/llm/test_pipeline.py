"""Every stage of the pipeline against a plain version of its rule, on its own input."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers as P

from tabsight.llm import bpe, mixing, queries
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages(spark, sf, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == documents.columns
        after = {r.doc_id: r for r in docs.collect()}
        assert all(before[i] == r for i, r in after.items())
        seen.append((before, set(after)))

    scores = {r.doc_id: r.score for r in queries.op8_toxicity(spark, sf).collect()}
    assert seen[0][1] == {i for i in seen[0][0] if scores[i] < 0.5}

    best = {}
    for i, r in seen[1][0].items():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), i))
    assert seen[1][1] == {i for _, i in best.values()}

    roots = brute_components({i: brute_fingerprint(r.text) for i, r in seen[2][0].items()})
    assert seen[2][1] == set(roots.values())

    rows = [(i, r.text, r.lang, r.source) for i, r in seen[3][0].items()]
    assert seen[3][1] == {x[0] for x in brute_mix(rows, queries.MIX) if x[-1]}

    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    enc = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert set(last) == seen[3][1]
    for i, r in last.items():
        text = seen[3][0][i].text
        assert r.n_tokens == len(enc.encode_ordinary(text))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_an_empty_table(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
