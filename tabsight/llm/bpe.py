"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at places where no match of the split pattern can cross, so each piece is
encoded alone with the ids of the whole text.  A text without such places (a long one without ASCII marks
or white space) is one piece.

Defined cases: a missing or empty text has no ids; repeated rows and repeated ids are encoded
row by row; extra columns of any name are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import arrow_pass, whole_text

# Between a word character and white space, or between an ASCII letter and other printable ASCII:
# every alternative of the pattern ends there, whatever stands around it.
SAFE_CUT = re.compile(r"(?<=\w)(?=[ \n\t\r])|(?<=[A-Za-z])(?=[!-@\[-`{-~])")
PIECE_CHARS = 1 << 15


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """One encoder for each worker process; each rank line is base64 bytes and an integer."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """The text in parts of about ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, enc, size: int = PIECE_CHARS) -> array:
    ids = array("I")
    for part in pieces(text, size):
        ids.extend(enc.encode_ordinary(part))
    return ids


def as_bytes(ids: array) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", round_trip: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids``; ``ids`` holds little-endian unsigned 32-bit integers.

    With ``round_trip`` the ids are decoded to raw bytes in the same pass (``decoded``).
    """
    schema = "doc_id long, n_tokens long, ids binary" + (", decoded binary" if round_trip else "")

    def run(rows: dict) -> dict:
        enc = encoder(rank_file, pattern)
        out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids": [], "decoded": []}
        for value in rows["text"]:
            ids = encode_text(value, enc)
            out["n_tokens"].append(len(ids))
            out["ids"].append(as_bytes(ids))
            if round_trip:
                out["decoded"].append(enc.decode_bytes(ids.tolist()))
        return out

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return arrow_pass(picked, run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, decoded``: the raw bytes of each row of ids; missing ids decode to no bytes."""

    def run(rows: dict) -> dict:
        enc = encoder(rank_file, pattern)
        out = []
        for value in rows["ids"]:
            ids = array("I", value or b"")
            out.append(enc.decode_bytes(ids.tolist()))
        return {"doc_id": rows["doc_id"], "decoded": out}

    return arrow_pass(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Digest columns of the encoded and decoded documents."""
    done = encode(docs, rank_file, pattern, round_trip=True)
    return done.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
