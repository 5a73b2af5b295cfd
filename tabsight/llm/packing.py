"""Best-fit packing planned on the length histogram.

Every task tokenizes its documents, cuts those over the capacity and numbers its pieces within their
length.  Summed over the tasks these numbers become ranks within a length, so no window sorts the
pieces of a common length.  The driver sees one count for each length only and plans best-fit
decreasing over the counts: bins with the same remaining capacity are runs of sequence numbers, and a length
fills whole runs at a time.  A piece then takes its slot by its length and rank.

The plan has at most a few rows for each length and open capacity, whatever the corpus size.  The ids are those
of the tokenizers library's ``encode``, added tokens included.

Defined cases: a missing or empty text is the end id alone; repeated rows and ids are packed each; a
missing ``doc_id`` stays missing; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.bpe import as_bytes, encode_text
from tabsight.llm.common import stored, whole_text

CAPACITY = 1024
END_ID = 2
BROADCAST_COUNTS = 300_000
ROWS_OUT = 1_024
RANK_BITS = 40

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, part int, place long"
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"

# Characters whose class no Unicode version changes: the Latin blocks, dashes and quotes, the euro sign.
LATIN_TEXT = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*")

# Fixed value: how byte-level vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Encoder:
    """Token ids of the vocabulary file as little-endian unsigned 32-bit integers.

    The library is several times slower than the byte-pair merges of tiktoken, so Latin texts take those, with
    ranks read from the same file; where its merges are not in the order of their ids, or a text holds
    another character or an added token, the library itself encodes the whole text.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, spec: dict):
        """The merges as a tiktoken encoding; none where their order or the splitting is another."""
        import tiktoken

        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and spec["post_processor"] is None and not model.get("ignore_merges")
        merged = [model["vocab"]["".join(pair)] for pair in model["merges"]] if model["type"] == "BPE" else []
        if not (plain and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]):
            return None
        if merged != sorted(set(merged)):
            return None
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
        return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids of a text, without the end id."""
        if self.merges is None or LATIN_TEXT.fullmatch(text) is None or any(t in text for t in self.added):
            return as_bytes(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids))
        return as_bytes(encode_text(text, self.merges))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Tokens of all pieces; ``place`` counts the pieces of the same length before it in task ``part``."""
    end = as_bytes(array("I", [end_id]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids", "part", "place"]
        rows = []

        def done():
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for i in range(batch.num_rows):
                data, doc_id = encode(texts[i].as_py()) + end, ids[i].as_py()
                for k, (at, n) in enumerate(cuts(len(data) // 4, capacity)):
                    rows.append((doc_id, k, at, n, data[4 * at : 4 * (at + n)], part, seen[n]))
                    seen[n] += 1
                    if len(rows) >= ROWS_OUT:
                        yield done()
                        rows = []
        if rows:
            yield done()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return picked.mapInArrow(run, PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first rank, per sequence, first sequence, offset)``.

    Pieces of the length from that rank on (up to the rank of the next row) stand ``per sequence`` side by side
    from ``offset`` on in sequences counted from ``first sequence``.  A sequence with the least room
    that is enough comes first, and one just filled is filled further while the length fits, as best
    fit does piece by piece.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first sequence, sequences)
    sizes: list[int] = []  # remaining capacities that have runs, ascending
    out, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first = capacity, sequences
                n = -(-todo // (capacity // length))
                sequences += n
            each = left // length
            full = min(n, todo // each)
            rest = min(todo - full * each, each) if full < n else 0
            for run_first, run_n, run_each in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if run_n:
                    out.append((length, rank, run_each, run_first, capacity - left))
                    rank += run_n * run_each
                    put(left - run_each * length, run_first, run_n)
            put(left, first + full + (1 if rest else 0), n - full - (1 if rest else 0))
            todo = counts[length] - rank
    return out


class Slots:
    """The plan as sorted arrays: the slot of a piece by its length and rank."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.key = table[:, 0] << RANK_BITS | table[:, 1]
        self.rank, self.each, self.first, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << RANK_BITS | rank, side="right") - 1
        inside = rank - self.rank[at]
        return self.first[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``, one row for each piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, capacity, text, end_id), "packing-pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row a length
    slots = spark.sparkContext.broadcast(Slots(plan({r.length: r.n for r in totals}, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_COUNTS:
        base = F.broadcast(base)
    ranked = cut.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("place")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, PACKED_SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the packed token sequences; a sequence holds at most its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
