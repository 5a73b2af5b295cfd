import hashlib
import re

from pyspark.sql import functions as F

from tabsight.llm import content_sort


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(content_sort.exact_groups(documents, partitions=7)) == brute(rows)


def test_a_group_over_many_partitions(table):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)] + [(900, "same  text"), (901, "sametext")]
    docs = table(rows).repartition(5)
    assert got(content_sort.exact_groups(docs, partitions=16)) == brute(rows)


def test_only_copies(table):
    rows = [(i, "a") for i in range(400)]
    assert got(content_sort.exact_groups(table(rows), partitions=9)) == brute(rows)


def test_edge_cases(table):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "é ü"), (5, "éü"), (6, " "), (7, "x" * 50_000), (8, "x" * 50_000)]
    docs = table(rows)
    assert got(content_sort.exact_groups(docs)) == brute(rows)
    clash = docs.withColumn("norm", F.lit(1)).withColumn("kept", F.lit(1)).withColumn("text_sha256", F.lit(1))
    assert got(content_sort.exact_groups(clash)) == brute(rows)
    kept = content_sort.drop_copies(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert content_sort.exact_groups(docs.limit(0)).count() == 0


def test_missing_ids_and_repeated_rows(table):
    docs = table([(None, "a b"), (2, "a b"), (2, "a b"), (None, "z"), (None, "z")])
    rows = content_sort.exact_groups(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows) == [
        ("2", "2", 3, False), ("2", "2", 3, True), ("None", "2", 3, False), ("None", "None", 2, False),
        ("None", "None", 2, True),
    ]
    assert sorted(str(r.doc_id) for r in content_sort.drop_copies(docs).collect()) == ["2", "None"]


def test_of_rows_with_one_id_the_longest_stays(table):
    docs = table([(1, "ab"), (1, "a b"), (2, "a  b"), (2, "z")])
    assert [(r.doc_id, r.text) for r in content_sort.drop_copies(docs.where("doc_id = 1")).collect()] == [(1, "a b")]
    clash = docs.withColumns({c: F.lit(7) for c in ("__id", "__digest", "points", "__points", "part", "edge", "size")})
    kept = content_sort.drop_copies(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a  b"), (2, "z")]
