"""Exact dedup by a content sort.

Texts without ASCII white space are range-partitioned by sampled splitters and sorted
externally; equal texts then stand next to each other, and one pass over each sorted partition
compares neighbours in full.  The splitters see a short prefix, the content digest and the
order within equal texts, so the driver's sample stays small and a text with a third of all
rows is cut over many partitions.  Runs that touch a partition edge are joined on the driver
from at most two rows for each partition.

Defined cases: a missing text is empty; of equal texts the one with most code points, then
the smallest ``doc_id`` stays, a missing id last; of rows that agree in both, one stays; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import no_ascii_space, stored, unused, whole_text

PREFIX_CHARS = 24
ROW_SCHEMA = (
    "doc_id long, points int, text_sha256 string, keep_id long, size long, is_first boolean, part int, edge int, edge_rows int"
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours within one sorted partition.

    Holds one text and the ids of the open run; a run is written when the next text differs.
    ``edge`` is 0 inside, 1 for the first run of the partition, 2 for the last, 3 for both.
    """
    part = TaskContext.get().partitionId()
    names = ["doc_id", "points", "text_sha256", "keep_id", "size", "is_first", "part", "edge", "edge_rows"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]

    def written(runs):
        """Arrow rows of closed runs: (ids, points, digest, edge)."""
        out = [[] for _ in names]
        for ids, points, digest, edge in runs:
            n = len(ids)
            for column, values in zip(out, (
                ids, points, [digest] * n, [ids[0]] * n, [n] * n, [True] + [False] * (n - 1), [part] * n, [edge] * n,
                [1] + [0] * (n - 1),
            )):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, kinds)], names=names)

    ids: list = []
    points: list = []
    text = digest = None
    first = True
    for batch in batches:
        closed = []
        ids_in, points_in = batch.column("doc_id").to_pylist(), batch.column("points").to_pylist()
        digests_in = batch.column("text_sha256").to_pylist()
        texts_in = batch.column("norm")
        for i, doc_id in enumerate(ids_in):
            if digests_in[i] == digest and texts_in[i].as_py() == text:
                ids.append(doc_id)
                points.append(points_in[i])
                continue
            if digest is not None:
                closed.append((ids, points, digest, 1 if first else 0))
                first = False
            ids, points, digest, text = [doc_id], [points_in[i]], digests_in[i], texts_in[i].as_py()
        if closed:
            yield written(closed)
    if digest is not None:
        yield written([(ids, points, digest, 3 if first else 2)])


def _joined_edges(edges: list) -> list[tuple]:
    """(part, edge, keep_id, size, starts) of runs at partition edges, chained across partitions."""
    chains: list[list] = []
    last = None
    for row in sorted(edges, key=lambda r: (r.part, r.edge == 2)):
        if last is not None and row.text_sha256 == last.text_sha256 and row.part != last.part:
            chains[-1].append(row)
        else:
            chains.append([row])
        last = row
    return [
        (row.part, row.edge, chain[0].keep_id, sum(r.size for r in chain), row is chain[0])
        for chain in chains if len(chain) > 1 for row in chain
    ]


def exact_groups(docs: DataFrame, text: str = "text", partitions: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each input row."""
    return _groups(docs, text, partitions).drop("points")


def _groups(docs: DataFrame, text: str, partitions: int | None = None) -> DataFrame:
    """``exact_groups`` with the ``points`` (code points) of each row's own text."""
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = whole_text(text)
    norm = no_ascii_space(raw)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.length(raw).alias("points"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    order = [
        F.substring("norm", 1, PREFIX_CHARS), F.col("text_sha256"), F.col("points").desc(),
        F.col("doc_id").asc_nulls_last(),
    ]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    runs = stored(
        dealt.select("doc_id", "points", "text_sha256", "norm").mapInArrow(_neighbours, ROW_SCHEMA), "content-runs"
    )
    edges = runs.where("edge > 0 and edge_rows = 1").select("part", "edge", "text_sha256", "keep_id", "size").collect()
    whole = spark.createDataFrame(
        _joined_edges(edges), "part int, edge int, chain_id long, chain_size long, starts boolean"
    )
    return runs.join(F.broadcast(whole), ["part", "edge"], "left").select(
        "doc_id", "points",
        F.when(F.col("chain_size").isNull(), F.col("keep_id")).otherwise(F.col("chain_id")).alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("is_first") & F.coalesce("starts", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with their columns: each is known by its id, its text's digest and its own length."""
    own, own_digest, own_points = unused(docs, "id", "digest", "points")
    digest = F.sha2(no_ascii_space(whole_text(text)).cast("binary"), 256)
    names = docs.columns
    kept = _groups(docs, text).where("kept").select("doc_id", "text_sha256", "points")
    marked = docs.select(
        "*", F.col("doc_id").cast("long").alias(own), digest.alias(own_digest), F.length(whole_text(text)).alias(own_points)
    )
    same = (
        marked[own].eqNullSafe(kept["doc_id"]) & (marked[own_digest] == kept["text_sha256"]) & (marked[own_points] == kept["points"])
    )
    return marked.join(kept, same, "left_semi").dropDuplicates([own, own_digest, own_points]).select(*names)
