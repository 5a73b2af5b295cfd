"""Helpers of the corpus operators: shared tables, hashing of ids, Arrow passes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session in one process (a local test) without the setting gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tabsight-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a read of committed files; unlike ``checkpoint()``
    the rows are computed once, column-pruned when read and compressed.  Tables stay until
    the folder is emptied.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column has (column names do not tell cases apart)."""
    taken = {x.lower() for x in df.columns}
    out = []
    for name in names:
        while f"__{name}".lower() in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def id_remainder(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def whole_text(text: str = "text") -> Column:
    """The text; a missing one is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def no_ascii_space(text: Column) -> Column:
    """The text without any of space, tab, newline, vertical tab, form feed and return."""
    return F.translate(text, ASCII_SPACE, "")


def arrow_pass(df: DataFrame, batch_fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Row-wise pass over Arrow batches: lists in, lists out, one batch in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out = batch_fn(batch.slice(start, 512).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, kind)
