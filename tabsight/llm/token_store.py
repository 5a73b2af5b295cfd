"""Token-id files with a shared zstandard dictionary.

Documents are range-partitioned and sorted by ``doc_id``, encoded, and compressed one by one against
one dictionary that is trained on serialized id arrays.  A file row is a block of documents: the frames one
after the other, their offsets, lengths and ids as an index, and the hash of the dictionary, which
stands in a table beside the blocks.  A short document is read by its offset and decompressed alone.
Spark's writer commits the blocks, so a lost task is written again and never twice.

The dictionary is fitted on about ``SAMPLE_DOCS`` documents, picked by a digest, with at most
``SAMPLE_TOKENS`` leading ids each; the bound only touches the compression ratio, never the ids.

White space never reaches a token of this vocabulary, so a text is the sequence of its words, and
words that were seen before are taken from a bounded memory of the worker.  The added tokens of the vocabulary
(``<|endoftext|>``) are cut out of the text first and give their own ids, as the library's ``encode`` does.

Defined cases: a missing or empty text is the end id alone; repeated ids keep their rows, by text;
a missing ``doc_id`` comes first; extra columns are ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.bpe import as_bytes as packed
from tabsight.llm.common import new_path, stored, whole_text

END_ID = 2
SAMPLE_DOCS = 2_000
SAMPLE_TOKENS = 4_096
DICTIONARY_BYTES = 112_640
LEVEL = 3
BLOCK_BYTES = 4 << 20
MEMORY_WORDS = 600_000
ASCII_LETTERS = b"abcdefghijklmnopqrstuvwxyz"

# One letter run of the Basic Latin and Latin-1 blocks, lower case: one pre-token, unchanged by the normaliser.
PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+")


@lru_cache(maxsize=2)
def _word_encoder(vocabulary: str):
    return WordEncoder(vocabulary)


class WordEncoder(dict):
    """Ids of words as little-endian unsigned 32-bit integers; the library encodes each word once.

    A bounded memory: once it holds ``memory`` words it starts anew.
    """

    def __init__(self, vocabulary: str, memory: int = MEMORY_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.memory, self.byte_char = memory, _byte_chars()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("only added tokens that match their exact text are supported")
        self.added = {t.content: packed(array("I", [i])) for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.memory:
            self.clear()
        if len(word) > 1 and word[-1] in b".," and word[-2] in ASCII_LETTERS:
            ids = self[word[:-1]] + self[word[-1:]]  # one mark behind a letter is a pre-token of its own
        elif PLAIN_WORD.fullmatch(text := word.decode()):
            mapped = text if text.isascii() else "".join(map(self.byte_char.__getitem__, word))
            ids = packed(array("I", [t.id for t in self.tokenize(mapped)]))
        else:
            ids = packed(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids))
        self[word] = ids
        return ids

    def whole_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with its added tokens, without the end id."""
        out = self.ids(texts)
        for i, text in enumerate(texts):
            if any(t in text for t in self.added):
                pieces = self.cut.split(text)  # texts between, and added tokens at odd places
                between = self.ids(pieces[::2])
                tokens = [self.added[t] for t in pieces[1::2]]
                out[i] = b"".join(x for pair in zip(between, [*tokens, b""]) for x in pair)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without the end id; added tokens are read as ordinary text."""
        get = self.__getitem__
        return [b"".join(map(get, t.encode("utf-8", "replace").lower().split())) for t in texts]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def encode_all(texts: list[str], vocabulary: str, end_id: int = END_ID) -> Iterator[bytes]:
    end = np.array([end_id], dtype="<u4").tobytes()
    for ids in _word_encoder(vocabulary).whole_ids(texts):
        yield ids + end


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))


def train_dictionary(docs: DataFrame, vocabulary: str, text: str = "text", end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from serialized id arrays of a bounded sample; empty if too little is there."""
    import zstandard

    rows = _rows(docs, text)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                texts = batch.column("text").slice(at, 128).to_pylist()
                ids = [x[: 4 * SAMPLE_TOKENS] for x in encode_all(texts, vocabulary, end_id)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.binary())], names=["ids"])

    sample = [r.ids for r in picked.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **shared), zstandard.ZstdDecompressor(**shared)


BLOCK_SCHEMA = (
    "part int, block int, dict_sha256 string, doc_ids array<long>, offsets array<long>, tokens array<long>, payload binary"
)


def write(docs: DataFrame, path: str, vocabulary: str, text: str = "text", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write ``<path>/blocks`` and ``<path>/dictionary`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, text, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        packer, _ = _codec(shared.value)
        ids, offsets, tokens, frames, size = [], [0], [], [], 0

        def done():
            return pa.RecordBatch.from_pydict(
                {
                    "part": [part], "block": [block], "dict_sha256": [digest], "doc_ids": [ids],
                    "offsets": [offsets], "tokens": [tokens], "payload": [b"".join(frames)],
                },
                schema=pa.schema(
                    [("part", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                     ("offsets", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("payload", pa.binary())]
                ),
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                texts = rows.column("text").to_pylist()
                for doc_id, data in zip(rows.column("doc_id").to_pylist(), encode_all(texts, vocabulary, end_id)):
                    frame = packer.compress(data)
                    ids.append(doc_id)
                    tokens.append(len(data) // 4)
                    frames.append(frame)
                    size += len(frame)
                    offsets.append(size)
                    if size >= BLOCK_BYTES:
                        yield done()
                        block += 1
                        ids, offsets, tokens, frames, size = [], [0], [], [], 0
        if ids:
            yield done()

    dealt = _rows(docs, text).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, dictionary)], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary does not match its hash")
    return data


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; ``start`` counts the ids of all documents before.

    The totals of the blocks are the only thing that is summed in order: one row for each block of
    ``BLOCK_BYTES``, by partition and then over the partitions.
    """
    from pyspark.sql import Window

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = stored(blocks.select("part", "block", total.alias("size")), "token-blocks")
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    over = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    bases = parts.select("part", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inside")).join(bases, "part").select(
        "part", "block", (F.col("base") + F.col("inside")).alias("first")
    )
    dictionary = spark.sparkContext.broadcast(_dictionary(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpacker = _codec(dictionary.value)
        digest = hashlib.sha256(dictionary.value).hexdigest()
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                if get("dict_sha256") != digest:
                    raise ValueError("a block names another dictionary")
                ids, offsets, tokens, payload = get("doc_ids"), get("offsets"), get("tokens"), get("payload")
                starts = get("first") + np.concatenate(([0], np.cumsum(tokens)))[:-1]
                for at in range(0, len(ids), 512):
                    span = range(at, min(at + 512, len(ids)))
                    data = [unpacker.decompress(payload[offsets[i] : offsets[i + 1]]) for i in span]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i] for i in span], type=pa.int64()), pa.array(starts[at : at + 512].astype(np.int64)),
                            pa.array([len(x) // 4 for x in data], type=pa.int64()), pa.array(data, type=pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    placed = blocks.join(starts, ["part", "block"]).select("dict_sha256", "doc_ids", "offsets", "tokens", "payload", "first")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_one(spark: SparkSession, path: str, doc_id: int) -> np.ndarray:
    """The ids of one document: the index finds its frame, and only that frame is decompressed."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    place = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    frame = F.expr("substring(payload, cast(offsets[p - 1] as int) + 1, cast(offsets[p] - offsets[p - 1] as int))")
    row = blocks.withColumn("p", place).where("p > 0").select(frame.alias("frame")).first()
    if row is None:
        raise KeyError(doc_id)
    return np.frombuffer(_codec(_dictionary(spark, path))[1].decompress(bytes(row.frame)), dtype="<u4")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)


