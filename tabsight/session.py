"""Session defaults for tests and local runs; a cluster brings its own session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabsight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hold(df: DataFrame) -> DataFrame:
    """Keep rows that many later jobs read.

    Where the session names a shared folder in ``spark.checkpoint.dir`` the rows are
    checkpointed there, so a lost executor costs a re-read; otherwise they are cached and
    recomputed from the source when lost.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist()
        context.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tabsight-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Evaluate a table bounded by the number of columns or levels once and keep the rows."""
    return df.sparkSession.createDataFrame([tuple(r) for r in df.collect()], df.schema)


def beside(*tables: DataFrame) -> DataFrame:
    """One-row tables side by side: every input holds exactly one aggregated row."""
    out = tables[0]
    for table in tables[1:]:
        out = out.crossJoin(table)
    return out


def small_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A driver-side table of already aggregated rows (per column, pair or level)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
