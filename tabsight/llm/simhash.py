"""SimHash near-dedup by a binary trie self-join.

Words and shingles follow the contract: A-Z lower-cased, words without ASCII white space,
three-word shingles with repeats, XXH64 with seed 42, a bit set where over half the hashes set
it.  Distinct fingerprints form a binary trie.  The trie is cut at a frontier of nodes that hold at most
``node_rows`` each: nodes over it after the first ``FRONTIER_BITS`` bits are counted again on their next bits, until
all are small.  Node pairs within the bit budget are found from the root down, and each pair is
traversed further inside one task: both nodes are split together bit by bit, differing bits add up, and a
pair is dropped when they exceed the budget.  A task writes a spanning forest of its
links, which keeps every component and no quadratic list.  Components come from label
propagation with pointer jumping over stored tables.

Defined cases: a text without words has fingerprint zero and is linked like any other; fewer
words than a shingle give one shingle; a missing text is empty; repeated rows are one
fingerprint; a missing ``doc_id`` is a document of its own and never names a component that
has another id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored, unused, whole_text

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
NODE_ROWS = 4_096
MAX_NODES = 4_096
FRONTIER_BITS = 18
NEXT_BITS = 10
HASH_BLOCK = 1 << 16
PAIR_BLOCK = 1 << 18


def fingerprint_of(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text; hashes are counted in blocks of bounded size."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASH_BLOCK):
        hashes = np.array(
            [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(firsts[at : at + HASH_BLOCK], lasts[at : at + HASH_BLOCK])],
            dtype=">u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, bits``: the fingerprint as a signed long, one row for each input row."""
    return _printed(docs, text, shingle).select("doc_id", "bits")


def _printed(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``fingerprints`` with ``text_hash``, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = np.fromiter(
                (fingerprint_of(texts[i].as_py(), shingle) for i in range(len(texts))), dtype=np.uint64, count=len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values.view(np.int64)), batch.column("text_hash")],
                names=["doc_id", "bits", "text_hash"],
            )

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"), F.xxhash64(whole_text(text)).alias("text_hash")
    )
    return picked.mapInArrow(run, "doc_id long, bits long, text_hash long")


def prefix_column(bits: str, depth: int):
    """The first ``depth`` bits of a fingerprint, as an int: the trie node at that depth."""
    return F.shiftrightunsigned(F.col(bits), 64 - depth).cast("int") if depth else F.lit(0)


def frontier(counts: dict[int, int], depth: int, node_rows: int) -> list[tuple[int, int]]:
    """(depth, prefix) of trie nodes that together hold all keys, split while they hold too many."""
    level, out = dict(counts), []
    sums = [level]
    for _ in range(depth):
        up: dict[int, int] = {}
        for prefix, n in sums[-1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        sums.append(up)
    todo = [(0, 0)]
    while todo:
        d, prefix = todo.pop()
        n = sums[depth - d].get(prefix, 0)
        if not n:
            continue
        if n <= node_rows or d == depth:
            out.append((d, prefix))
        else:
            todo += [(d + 1, 2 * prefix), (d + 1, 2 * prefix + 1)]
    return out


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of frontier nodes (by position) whose common bits differ in at most ``budget`` places.

    Walks the trie of the frontier with pairs of its inner nodes and prunes as in the tasks.
    """
    place = {node: i for i, node in enumerate(nodes)}
    inner = {(d - k, p >> k) for d, p in nodes for k in range(1, d + 1)}
    out, todo = [], [((0, 0), (0, 0), 0)]
    while todo:
        a, b, diff = todo.pop()
        if a in place and b in place:
            out.append((min(place[a], place[b]), max(place[a], place[b])))
            continue
        grow = [a in inner, b in inner]
        for x in ((0, 1) if grow[0] else (None,)):
            for y in ((0, 1) if grow[1] else (None,)):
                if a == b and x is not None and y is not None and x > y:
                    continue
                na = (a[0] + 1, 2 * a[1] + x) if x is not None else a
                nb = (b[0] + 1, 2 * b[1] + y) if y is not None else b
                if not ((na in place or na in inner) and (nb in place or nb in inner)):
                    continue
                shared = min(na[0], nb[0])
                d = bin((na[1] >> (na[0] - shared)) ^ (nb[1] >> (nb[0] - shared))).count("1")
                if d <= budget:
                    todo.append((na, nb, d))
    return sorted(set(out))


LEVELS = 64


def linked(left: np.ndarray, right: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted key arrays within ``budget`` bits, by descending both tries together.

    Each step takes one bit: children of a node are ranges of the sorted keys, a node pair becomes
    the pairs of their children, and those over the budget are dropped.  Pairs are
    walked depth first in blocks, so memory stays bounded.
    """

    def starts(keys, level):
        """Where the first ``level + 1`` bits change: the children of all nodes at a level."""
        heads = keys >> np.uint64(LEVELS - level - 1)
        return np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [len(keys)]))

    tables = [(starts(left, k), starts(right, k)) for k in range(LEVELS)]
    stack = [(0, np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([0], dtype=np.int8))]
    while stack:
        level, alo, ahi, blo, bhi, diff = stack.pop()
        if level == LEVELS:
            yield alo, blo
            continue
        cuts_a, cuts_b = tables[level]
        fa, la = np.searchsorted(cuts_a, alo), np.searchsorted(cuts_a, ahi)
        fb, lb = np.searchsorted(cuts_b, blo), np.searchsorted(cuts_b, bhi)
        na, nb = la - fa, lb - fb
        total = na * nb
        if total.sum() > PAIR_BLOCK and len(total) > 1:  # halve the block of pairs, and go on depth first
            half = len(total) // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((level, alo[part], ahi[part], blo[part], bhi[part], diff[part]))
            continue
        pair = np.repeat(np.arange(len(total)), total)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
        ia, ib = fa[pair] + inside // nb[pair], fb[pair] + inside % nb[pair]
        shift = np.uint64(LEVELS - level - 1)
        xa, xb = left[cuts_a[ia]] >> shift, right[cuts_b[ib]] >> shift
        new = diff[pair] + ((xa ^ xb) & np.uint64(1)).astype(np.int8)
        keep = new <= budget
        if same:  # each unordered pair once, a key never with itself at the end
            keep &= (cuts_a[ia] <= cuts_b[ib]) if level < LEVELS - 1 else (cuts_a[ia] < cuts_b[ib])
        ia, ib, new = ia[keep], ib[keep], new[keep]
        if len(ia):
            stack.append((level + 1, cuts_a[ia], cuts_a[ia + 1], cuts_b[ib], cuts_b[ib + 1], new))


def _forest(keys_a, keys_b, same, budget):
    """A spanning forest of the links between two sorted key arrays, as key pairs.

    Links come in blocks; those within one tree so far are dropped as arrays, so the loop runs over
    links that may join two trees only.
    """
    keys = keys_a if same else np.union1d(keys_a, keys_b)
    place_a, place_b = np.searchsorted(keys, keys_a), np.searchsorted(keys, keys_b)
    parent, out = np.arange(len(keys)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked(keys_a, keys_b, same, budget):
        i, j = place_a[i], place_b[j]
        while True:
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent[:] = flat
        apart = np.flatnonzero(parent[i] != parent[j])
        # Of the links between the same two trees the first is enough.
        _, once = np.unique(np.stack([np.minimum(parent[i[apart]], parent[j[apart]]), np.maximum(parent[i[apart]], parent[j[apart]])]), axis=1, return_index=True)
        for x, y in zip(i[apart[once]].tolist(), j[apart[once]].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((int(keys[x]), int(keys[y])))
    return out


def _cut_nodes(keys: DataFrame, node_rows: int, depth: int) -> list[tuple[int, int]]:
    """(depth, prefix) of disjoint trie nodes of at most ``node_rows`` distinct fingerprints each.

    Nodes that are still too large are counted on their next bits; the driver sees the counts of
    at most 2 ** NEXT_BITS children of each of those, of which total / node_rows exist at most.
    """
    spark = keys.sparkSession
    counts = {r.leaf: r["count"] for r in keys.groupBy(prefix_column("bits", depth).cast("long").alias("leaf")).count().collect()}
    nodes, todo = [], [(0, 0, depth, counts)]
    while todo:
        large = []
        for d, prefix, step, own in todo:
            for k, p in frontier(own, step, node_rows):
                node = (d + k, prefix << k | p)
                if k == step and own[p] > node_rows and node[0] < LEVELS:
                    large.append(node)
                else:
                    nodes.append(node)
        todo = []
        for d in sorted({d for d, _ in large}):  # nodes of one depth at a time
            step = min(NEXT_BITS, LEVELS - d)
            some = spark.createDataFrame([(_signed(p, d),) for k, p in large if k == d], "head long")
            inside = F.shiftrightunsigned(F.shiftleft("bits", d), LEVELS - step)
            found = (
                keys.withColumn("head", F.shiftrightunsigned("bits", LEVELS - d)).join(F.broadcast(some), "head")
                .groupBy("head", inside.alias("leaf")).count().collect()
            )
            by_head: dict[int, dict[int, int]] = {}
            for r in found:
                by_head.setdefault(r.head, {})[r.leaf] = r["count"]
            todo += [(d, p, step, by_head[_signed(p, d)]) for k, p in large if k == d]
    return nodes


def _signed(prefix: int, depth: int) -> int:
    """The prefix as the long that a logical shift gives."""
    return prefix - (1 << 64) if depth == LEVELS and prefix >= 1 << 63 else prefix


def links(keys: DataFrame, budget: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``bits``) that keep every component.

    The driver sees prefix counts and the pairs of at most about 2 * MAX_NODES frontier nodes, whatever the
    corpus size; the size that nodes may have grows instead, and each is held by one task at a time.
    """
    spark = keys.sparkSession
    total = keys.count()
    node_rows = max(node_rows, total // MAX_NODES)
    depth = min(FRONTIER_BITS, max(4, math.ceil(math.log2(max(1, total / node_rows))) + 6))
    nodes = sorted(_cut_nodes(keys, node_rows, depth), key=lambda n: n[1] << (LEVELS - n[0]))
    pairs = node_pairs(nodes, budget)
    takers: list[list[tuple[int, int, bool]]] = [[] for _ in nodes]  # (pair, side, same) of each node
    for k, (a, b) in enumerate(pairs):
        takers[a].append((k, 0, a == b))
        if a != b:
            takers[b].append((k, 1, False))
    starts = np.array([p << (LEVELS - d) for d, p in nodes], dtype=np.uint64)
    shared = spark.sparkContext.broadcast((starts, takers))  # as many rows as node pairs

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, takers = shared.value
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            node = np.searchsorted(starts, bits.view(np.uint64), side="right") - 1
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                own = bits[order[lo:hi]]
                for k, side, same in takers[node[order[lo]]]:
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k, dtype=np.int32)), pa.array(np.full(n, side, dtype=np.int32)), pa.array(np.full(n, same)), pa.array(own)],
                        names=["pair", "side", "same", "bits"],
                    )

    def run(pdf):
        import pandas as pd

        bits = pdf["bits"].to_numpy().astype(np.int64).view(np.uint64)
        side = pdf["side"].to_numpy()
        same = bool(pdf["same"].iloc[0])
        left = np.sort(bits[side == 0])
        right = left if same else np.sort(bits[side == 1])
        found = _forest(left, right, same, budget) if len(left) and len(right) else []
        flat = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": flat[:, 0], "b": flat[:, 1]})

    # Sorted by node, a partition hands out few large batches.
    dealt = keys.select("bits").sortWithinPartitions("bits").mapInArrow(deal, "pair int, side int, same boolean, bits long")
    return dealt.groupBy("pair").applyInPandas(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label``: the smallest node reachable over edges ``a, b``, for nodes with an edge.

    Every round hooks each node and its parent to the smallest grandparent among its neighbours, and
    shortens its own path; the rounds grow with the logarithm of the longest chain.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges"
    )
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        grand = labels.join(up, "label").select("node", "label", "grand")
        grand = stored(grand, f"{name}-grand")
        near = (
            both.join(grand.select(F.col("node").alias("b"), F.col("grand").alias("seen")), "b")
            .groupBy("a").agg(F.min("seen").alias("seen")).withColumnRenamed("a", "node")
        )
        reach = stored(grand.join(near, "node"), f"{name}-reach")
        new = (
            reach.select("node", F.least("grand", "seen").alias("label"))
            .union(reach.select(F.col("label").alias("node"), F.col("seen").alias("label")))
            .groupBy("node").agg(F.min("label").alias("label"))
        )
        new = stored(new, name)
        old = labels.select("node", F.col("label").alias("old"))
        if new.join(old, "node").where("label <> old").limit(1).count() == 0:
            return new
        labels = new


def near_groups(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """``doc_id, bits, component_id``, one row for each input row."""
    return _grouped(docs, text, shingle, budget).drop("text_hash")


def _grouped(docs: DataFrame, text: str, shingle: int, budget: int) -> DataFrame:
    rows = stored(_printed(docs, text, shingle), "simhash")
    keys = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-keys")
    labels = components(stored(links(keys, budget), "simhash-links"), "simhash-labels")
    named = keys.join(labels.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first_id", F.coalesce("label", "bits").alias("label")
    )
    named = stored(named, "simhash-named")
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    whole = stored(named.join(ids, "label").select("bits", "component_id"), "simhash-components")
    return rows.join(whole, "bits").select("doc_id", "bits", "component_id", "text_hash")


def fingerprint_text(bits: str = "bits"):
    """16 lower-case hex digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(bits)), 16, "0"))


def keep_one(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """The documents that name their component, with their columns; one of repeated rows.

    A row is known by its id and text, so of rows with one id only those of the component that the id names stay.
    """
    own, own_hash = unused(docs, "id", "text_hash")
    kept = _grouped(docs, text, shingle, budget).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash")
    marked = docs.select("*", F.col("doc_id").cast("long").alias(own), F.xxhash64(whole_text(text)).alias(own_hash))
    same = marked[own].eqNullSafe(kept["doc_id"]) & (marked[own_hash] == kept["text_hash"])
    return marked.join(kept, same, "left_semi").dropDuplicates([own, own_hash]).select(*docs.columns)
