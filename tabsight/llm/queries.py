"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import (
    bpe,
    content_sort,
    conversation_trie,
    langid,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    spelling,
    token_store,
    toxicity,
    winnow,
)
from tabsight.llm.common import id_remainder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Shares of the training mix; missing and unnamed sources and languages share REST_SHARE, which goes to the named ones where there are none.
REST_SHARE = 0.05
MIX = mixing.Targets(
    source={f"src{i}": 0.05 * (1 - REST_SHARE) for i in range(20)},
    lang={k: share * (1 - REST_SHARE) for k, share in {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}.items()},
    topic={"prose": 0.7, "legal": 0.1, "contact": 0.1, "table": 0.1},
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_fingerprints(spark, sf_dir):
    return winnow.summary(table(spark, sf_dir, "documents"), rolling=True)


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_token_ids(spark, sf_dir):
    back = token_store.round_trip(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_exact_dedup(spark, sf_dir):
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


@query
def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = quality_rules.train(quality_rules.labelled(docs.where(~held_out), labels, "quality"))
    return quality_rules.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op6_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), MIX)


@query
def op7_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
        "n_mixed", "n_live", "n_shared",
    )


@query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(toxicity.labelled(docs.where(~held_out), labels, "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op9_simhash(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


@query
def op10_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text whose characters are below U+0800, bit by bit."""
    code = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    utf8 = f"flatten(list_transform({code}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {utf8}), lambda a, b: {bits}), 4294967295::BIGINT)"


# Words one edit apart share a text with one letter deleted, at the same place, or are that text.
ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
        FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT w, n, {crc32_sql("concat(id, ':', w)")} AS h FROM low),
d AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(w, (h % length(w))::INT), substr(w, (h % length(w))::INT + 2)) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM v),
cut AS (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM p),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, s.word, s.n FROM cut a JOIN v s ON a.rest = s.word UNION SELECT s.word, a.word, a.n FROM cut a JOIN v s ON a.rest = s.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
f AS (SELECT v.word, v.n, CASE WHEN m >= 10 * v.n THEN other END AS form, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, w.at AS root, f.n_near, f.form_n FROM f JOIN walk w USING (word) JOIN f g ON g.word = w.at WHERE g.form IS NULL
"""


@query
def op12_best_fit_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.trie(conversation_trie.rebuild(table(spark, sf_dir, "conversations")))


ORACLES["op13_conversation_trie"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:h.h] END, h.turns[h.h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.base),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
m AS (SELECT conv_id, depth, s[1:depth] AS pre, depth = len(s) AS ends FROM p),
n AS (SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY depth, pre),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(pre[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n),
k AS (SELECT depth - 1 AS depth, pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT w.*, coalesce(k.n_children, 0) AS n_children FROM w LEFT JOIN k ON k.depth = w.depth AND k.pre = w.pre),
b AS (SELECT a.depth, a.pre, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
      FROM n a JOIN x ON x.depth >= a.depth AND x.pre[1:a.depth] = a.pre GROUP BY ALL)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, b.n_leaves, b.saved_tokens, x.ends_sha256
FROM x JOIN b ON b.depth = x.depth AND b.pre = x.pre LEFT JOIN n u ON u.depth = x.depth - 1 AND u.pre = x.pre[1:x.depth - 1]
"""
