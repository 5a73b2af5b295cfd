"""Prefix trie of conversations by whole-sequence collapse.

Rebuilt conversations that are identical become one weighted sequence with the list of its ends; a
sequence that is no proper prefix of another (an anti-join) is a leaf; the prefixes of the weighted
sequences, summed by prefix, are the nodes.  A prefix is named by its depth and the exclusive or of a 128-bit
digest of each of its turns with their places, so a running value over the turns gives all prefixes
of a conversation, and no turn list is ever held.

Numbers and running values come from ``running``: rows are range-partitioned in order, each task
accumulates its own range, and what crosses a partition edge is one row a partition.  A conversation with a third of all
rows is therefore spread over many tasks, and so are the ends of a sequence.  Sums over subtrees need
no descent: a node's subtree is what the sequences through it hold below it, minus the words of
its distinct nodes, each counted for the one sequence that names it.  Parents with very many children are
found by count (at most ``1 / HOT_SHARE`` exist) and looked up by broadcast.

One digest of many ends is one SHA-256 stream: such ids are joined to text in all tasks, and one
task then passes over these texts block by block.

Defined cases: rows without ``conv_id`` belong to no conversation and are left out; turns that tie are ordered by role and text;
repeated rows are repeated turns; a missing role or text is empty; a conversation whose rebuilt form has no turn
ends in the root; extra columns are ignored; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import ASCII_SPACE, stored

GROUP = 20
HEADS = 4
SALT_TURNS = 4_096
HOT_CHILDREN = 10_000
HOT_SHARE = 1 / 20_000
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 8_192


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row number, running exclusive or of ``x1, x2`` and sum of ``words`` by conversation, within one sorted task."""
    part, open_id, carry, last = TaskContext.get().partitionId(), None, (0, 0, 0, 0), None
    for batch in batches:
        if not batch.num_rows:
            continue
        n, ids = batch.num_rows, batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.concatenate(([open_id is None or ids[0] != open_id], ids[1:] != ids[:-1])))
        segment = np.searchsorted(starts, np.arange(n), side="right")  # 0: goes on from the batch before
        out = []
        for k, column in enumerate((None, "x1", "x2", "words")):
            value = batch.column(column).to_numpy() if column else np.ones(n, dtype=np.int64)
            xor = column in ("x1", "x2")
            total = np.concatenate(([0], np.bitwise_xor.accumulate(value) if xor else np.add.accumulate(value)))
            before = np.concatenate(([0], total[starts]))[segment]  # the running value where the conversation starts
            before[segment == 0] = carry[k] if xor else -carry[k]
            out.append(total[1:] ^ before if xor else total[1:] - before)
        open_id, carry = int(ids[-1]), tuple(int(x[-1]) for x in out)
        if last is not None:
            yield last
        last = pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, out), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool))],
            names=[*batch.schema.names, "n", "k1", "k2", "cum", "part", "tail"],
        )
    if last is not None:
        tail = np.zeros(last.num_rows, dtype=bool)
        tail[-1] = True
        yield last.set_column(last.schema.get_field_index("tail"), "tail", pa.array(tail))


def running(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``n, k1, k2, cum`` over each ``conv_id`` in ``order``: numbers and running ``x1, x2, words``."""
    spark = rows.sparkSession
    keys = [F.col("conv_id"), *order]
    dealt = rows.repartitionByRange(_parts(rows), *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    held = stored(
        dealt.mapInArrow(_accumulated, schema + ", n bigint, k1 bigint, k2 bigint, cum bigint, part int, tail boolean"),
        name,
    )
    edges = held.where("tail").select("part", "conv_id", "n", "k1", "k2", "cum").collect()  # one row a partition
    bases, open_id, carry = [], None, (0, 0, 0, 0)
    for r in sorted(edges, key=lambda r: r.part):
        if open_id is not None:
            bases.append((r.part, open_id, *carry))
        same = r.conv_id == open_id
        carry = (carry[0] + r.n, carry[1] ^ r.k1, carry[2] ^ r.k2, carry[3] + r.cum) if same else (r.n, r.k1, r.k2, r.cum)
        open_id = r.conv_id
    base = spark.createDataFrame(bases, "part int, conv_id long, b0 long, b1 long, b2 long, b3 long")
    b = lambda k: F.coalesce(F.col(k), F.lit(0))
    return held.join(F.broadcast(base), ["part", "conv_id"], "left").select(
        *rows.columns, (F.col("n") + b("b0")).alias("n"), F.col("k1").bitwiseXOR(b("b1")).alias("k1"),
        F.col("k2").bitwiseXOR(b("b2")).alias("k2"), (F.col("cum") + b("b3")).alias("cum"),
    )


def rebuild(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``conv_id, depth, role, text``: each conversation behind the first turns of its group's first.

    With ``h = crc32(conv_id as text) mod heads``, turns 1..h come from conversation ``conv_id - conv_id % group``, the
    others are its own after its first h.  A row with depth 0 stands for each conversation.
    """
    none = F.lit(0).cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        none.alias("x1"), none.alias("x2"), none.alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    own = running(turns, order, "trie-turns").select("conv_id", F.col("n").alias("at"), "role", "text")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    first = own.where(F.col("at") < heads)
    ids = first.where("at = 1").select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    head = first.where(F.col("conv_id") % group == 0).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns")  # fewer than ``heads`` turns
    )
    got = ids.join(head, "base", "left").select(
        "conv_id", "h", F.when(F.col("turns").isNotNull(), F.slice("turns", F.lit(1), F.col("h").cast("int"))).alias("turns")
    )
    got = stored(got, "trie-heads")
    heads_out = got.select("conv_id", F.explode("turns").alias("t")).select("conv_id", F.col("t.at").alias("depth"), "t.role", "t.text")
    taken = F.greatest(F.size("turns"), F.lit(0)).alias("m")
    size = got.select("conv_id", "h", taken, F.lit(0).alias("salt"))
    # The rest of a conversation meets its own h by id; pieces of a long one are apart by salt.
    pieces = own.where(F.col("at") >= heads).groupBy("conv_id").agg(F.max("at").alias("last"))
    more = pieces.select("conv_id", F.explode(F.sequence(F.lit(1), (F.col("last") / SALT_TURNS).cast("int") + 1)).alias("salt"))
    sized = size.union(got.join(more, "conv_id").select("conv_id", "h", taken, "salt"))
    salt = F.when(F.col("at") < heads, 0).otherwise((F.col("at") / SALT_TURNS).cast("int") + 1)
    rest = own.withColumn("salt", salt).join(sized, ["conv_id", "salt"]).where("at > h").select(
        "conv_id", (F.col("m") + F.col("at") - F.col("h")).alias("depth"), "role", "text"
    )
    start = got.select("conv_id", none.alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return start.union(heads_out).union(rest)


def _lanes(of: list[Column]) -> list[Column]:
    """Two signed 64-bit halves of an MD5 digest."""
    digest = F.md5(F.concat(*of).cast("binary"))
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def _words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(F.translate(text, ASCII_SPACE, " " * len(ASCII_SPACE)), " "), lambda w: w != "")).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, words, cum`` of every prefix: its key, its parent's, words of the last turn and of all."""
    deep = F.col("depth") > 0
    lanes = _lanes([F.col("depth").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")])
    rows = turns.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        *[F.when(deep, x).otherwise(0).alias(c) for c, x in zip(("x1", "x2"), lanes)],
        F.when(deep, _words(F.col("text"))).otherwise(0).alias("words"),
    )
    return running(rows, [F.col("depth")], "trie-prefixes").select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", "cum",
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the runs of equal keys in one sorted task; the runs at its edges come as text blocks."""
    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    names = ["depth", "k1", "k2", "part", "block", "ids", "digest"]
    key, held, size, block, first, rows = None, [], 0, 0, True, []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for *new, conv_id in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "conv_id"))):
            if new != key:
                if held:
                    text = ",".join(held).encode()
                    edge = first or block > 0
                    rows.append((*key, part, block, text if edge else None, None if edge else hashlib.sha256(text).hexdigest()))
                first = first and key is None
                key, held, size, block = new, [], 0, 0
            held.append(str(conv_id))
            size += len(held[-1]) + 1
            if size >= BLOCK_BYTES:
                rows.append((*key, part, block, ",".join(held).encode(), None))
                held, size, block = [], 0, block + 1
            if len(rows) >= BATCH_ROWS or block and rows:
                yield batch_of(rows)
                rows = []
    if held:
        rows.append((*key, part, block, ",".join(held).encode(), None))
    if rows:
        yield batch_of(rows)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of text blocks, in the order of the rows."""
    key, state, rows = None, None, []

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=["depth", "k1", "k2", "digest"])

    for batch in batches:
        ids = batch.column("ids")
        for i, new in enumerate(zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2")))):
            if new == key:
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = new, hashlib.sha256()
            state.update(ids[i].as_py())
        if len(rows) >= BATCH_ROWS:
            yield batch_of(rows)
            rows = []
    if key is not None:
        rows.append((*key, state.hexdigest()))
    if rows:
        yield batch_of(rows)


KEY = ["depth", "k1", "k2"]


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, digest`` over ``depth, k1, k2, conv_id``: SHA-256 of the ascending ids of each key, comma-joined."""
    order = [*map(F.col, KEY), F.col("conv_id")]
    dealt = ends.select(*KEY, "conv_id").repartitionByRange(_parts(ends), *order).sortWithinPartitions(*order)
    runs = stored(
        dealt.mapInArrow(_joined_ids, "depth long, k1 long, k2 long, part int, block int, ids binary, digest string"), "trie-ends"
    )
    blocks = runs.where("digest is null").repartition(_parts(ends), *KEY).sortWithinPartitions(*KEY, "part", "block")
    chained = blocks.select(*KEY, "ids").mapInArrow(_chained, "depth long, k1 long, k2 long, digest string")
    return runs.where("digest is not null").select(*KEY, "digest").union(chained)


def _with_sequence(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Join by ``rep``; the rows of a long sequence are apart by salt."""
    salted = sequences.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("length") / SALT_TURNS).cast("int"))))
    return rows.withColumn("salt", (F.col("depth") / SALT_TURNS).cast("int")).join(salted.drop("length"), ["rep", "salt"]).drop("salt")


def _parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """``depth, k1, k2, parent_conv_id`` of all nodes but the root.

    ``children`` holds the number of children by parent key.  Parents with more than a fixed share of all nodes
    are few whatever the size and are broadcast; what is left has no hot key.
    """
    total = children.agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n")).first().n
    hot = F.broadcast(children.where(F.col("n_children") >= max(HOT_CHILDREN, int(total * HOT_SHARE))).select(*KEY))
    named = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").select(
        F.col("depth").alias("own"), F.col("k1").alias("o1"), F.col("k2").alias("o2"),
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"),
    )
    hot_named = F.broadcast(named.join(hot, KEY))
    found = below.join(hot_named, KEY).unionByName(below.join(hot, KEY, "left_anti").join(named, KEY))
    return found.select(F.col("own").alias("depth"), F.col("o1").alias("k1"), F.col("o2").alias("k2"), "parent_conv_id")


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of ``conv_id, depth, role, text`` (a row of depth 0 for each conversation).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    rows = stored(prefixes(turns), "trie-rows")
    ends = stored(
        rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "cum")).alias("e")).select("conv_id", "e.depth", "e.k1", "e.k2", "e.cum"),
        "trie-ends-by-conversation",
    )
    sequences = stored(
        ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), F.max("cum").alias("total")),
        "trie-sequences",
    )
    length = F.col("depth").alias("length")
    paths = stored(
        _with_sequence(rows.withColumnRenamed("conv_id", "rep"), sequences.select("rep", length, "weight", "total", F.col("depth").alias("whole"))),
        "trie-paths",
    )
    before = F.col("cum") - F.col("words")  # words before the node's own turn
    inner = paths.where("depth < whole").select(*KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = stored(
        paths.groupBy(*KEY).agg(
            F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
            F.max(before).alias("before"), F.sum(F.col("weight") * (F.col("total") - before)).alias("held"),
        ),
        "trie-nodes",
    )
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min(F.struct("depth", "before")).alias("top")).select(
        "rep", F.col("top.depth").alias("from"), F.col("top.before").alias("skipped")
    )
    info = sequences.select("rep", length).join(leaves, "rep", "left").join(owned, "rep", "left")
    # Words of the distinct nodes that a sequence names, at or below the prefix.
    distinct = (
        F.when(F.col("from").isNull(), 0).when(F.col("depth") >= F.col("from"), F.col("total") - before)
        .otherwise(F.col("total") - F.col("skipped"))
    )
    below = _with_sequence(paths, info).groupBy(*KEY).agg(
        F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(distinct).alias("once")
    )
    children = stored(
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count("*").alias("n_children")
        ),
        "trie-children",
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(below, KEY).join(children, KEY, "left").join(ends_digest(ends), KEY, "left").join(_parents(nodes, children), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
            (F.col("held") - F.col("once")).alias("saved_tokens"), F.coalesce("digest", F.lit(nothing)).alias("ends_sha256"),
        )
    )
