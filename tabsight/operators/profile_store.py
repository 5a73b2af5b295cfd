"""A saved profile that grows with its table.

``add`` profiles one batch of rows (a new file, a new day) and saves the groups of each column: distinct
values or digests with their counts, and the row hashes with theirs.  All of them add up, so the exact facts,
duplicates, quantiles and fingerprint of everything added come from the saved groups, without a
second scan of any earlier rows.  Texts above 32 bytes are saved as digests only.

Layout under the store's folder, all Parquet, each batch by the fingerprint of its rows:
``values/c<i>/batch=<fingerprint>`` for column i, ``rows/batch=<fingerprint>``, and one row a batch in
``batches/batch=<fingerprint>``.  That row is written last: what a lost driver left behind is not
listed, and ``add`` of the same batch writes it again.

Defined cases: a batch that is listed already is left as it is (adding twice counts once); a batch with other
names or types than the first raises; an empty batch counts as a batch of no rows; a store without batches
raises when read.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import ref
from . import profile
from .clean import family, sanitize
from .ordered import quantiles_of_counts
from .profile import LANES, union_all

# Folders of a batch that are written side by side.
WRITERS = 4
BATCHES = "batch string, schema string, fields string, rows bigint, " + ", ".join(f"{x} decimal(38,0)" for x in LANES)


@dataclass(frozen=True)
class ProfileStore:
    """The saved profile in ``path``, a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def batches(self) -> DataFrame:
        """One row for each batch: fingerprint, schema, number of rows and digest sums."""
        try:
            return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], BATCHES)

    def add(self, df: DataFrame) -> str:
        """Profile ``df`` and save it as one batch; the batch's fingerprint.

        Rows are read twice, once for the fingerprint that names the batch and once for the groups.
        """
        frame = sanitize(df)
        schema, sums = profile.schema_text(frame), profile.fingerprint_sums(frame).collect()
        small = self.spark.createDataFrame(sums, "rows bigint, " + ", ".join(f"{x} decimal(38,0)" for x in LANES))
        batch = profile.sealed(small, schema).first().fingerprint
        known = self.batches().select("batch", "schema").collect()
        if any(r.schema != schema for r in known):
            raise ValueError(f"the store holds columns {known[0].schema}, the batch {schema}")
        if any(r.batch == batch for r in known):
            return batch
        groups = {f"values/c{i}": profile.column_groups(frame, f) for i, f in enumerate(frame.schema.fields)}
        groups["rows"] = profile.row_groups(frame)
        # The next folder's tasks fill the cores that the last tasks of one leave free.
        with ThreadPoolExecutor(max_workers=WRITERS) as pool:
            list(pool.map(lambda part: groups[part].write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch}"), groups))
        entry = small.select(F.lit(schema).alias("schema"), F.lit(frame.schema.json()).alias("fields"), "rows", *LANES)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
        return batch

    def _listed(self) -> tuple[list[str], list[T.StructField]]:
        rows = self.batches().select("batch", "fields").collect()
        if not rows:
            raise ValueError(f"no profile in {self.path}")
        return sorted(r.batch for r in rows), T.StructType.fromJson(json.loads(rows[0].fields)).fields

    def _saved(self, part: str, batches: list[str]) -> DataFrame:
        """The rows of the listed batches; other folders are not read."""
        return self.spark.read.parquet(*[f"{self.path}/{part}/batch={b}" for b in batches])

    def groups(self, name: str) -> DataFrame:
        """The merged groups of one column."""
        batches, fields = self._listed()
        return self._groups(batches, fields, [f.name for f in fields].index(name))

    def _groups(self, batches: list[str], fields: list[T.StructField], i: int) -> DataFrame:
        return profile.merged_groups(self._saved(f"values/c{i}", batches), fields[i])

    def facts(self) -> DataFrame:
        """The facts of all added rows, as ``column_facts`` gives them for the whole table."""
        batches, fields = self._listed()
        measured = []
        for start in range(0, len(fields), profile.COLUMNS_PER_JOB):
            places = range(start, min(start + profile.COLUMNS_PER_JOB, len(fields)))
            measured += union_all(
                [profile.group_facts(self._groups(batches, fields, i), i, fields[i]) for i in places]
            ).collect()
        place = {f.name: i for i, f in enumerate(fields)}
        gaps = [
            profile.gap_facts(self._saved(f"values/c{place[name]}", batches).selectExpr(f"k AS {ref(name)}"), {name: whole})
            for name, whole in profile.sequential(measured).items()
        ]
        return profile.fact_table(self.spark, measured, union_all(gaps).collect() if gaps else [])

    def overview(self) -> DataFrame:
        """Size, missing cells, duplicates and constants of all added rows."""
        return profile.overview_of(self.facts(), self.duplicate_rows())

    def duplicate_rows(self) -> DataFrame:
        """Rows equal to another one, within a batch or across batches."""
        batches, _ = self._listed()
        return profile.repeats(self._saved("rows", batches).groupBy("h1", "h2").agg(F.sum("n").alias("n")))

    def quantiles(self, fractions: list[float], names: list[str] | None = None) -> DataFrame:
        """``column, fraction, value``: exact quantiles of the numeric columns."""
        batches, fields = self._listed()
        places = [i for i, f in enumerate(fields) if family(f.dataType) == "numeric" and (names is None or f.name in names)]
        schema = "column string, fraction double, value double"
        if not places:
            return self.spark.createDataFrame([], schema)
        counts = union_all([
            self._groups(batches, fields, i).where("k IS NOT NULL AND NOT isnan(double(k))")
            .select(F.lit(f"q{i}").alias("name"), F.col("k").cast("double").alias("x"), "n")
            for i in places
        ])
        found = quantiles_of_counts(counts, [f"q{i}" for i in places], fractions)
        rows = [(fields[i].name, q, x) for i, values in zip(places, found, strict=True) for q, x in zip(fractions, values, strict=True)]
        return self.spark.createDataFrame(rows, schema)

    def fingerprint(self) -> DataFrame:
        """The fingerprint of all added rows, equal to that of one table with all of them."""
        self._listed()
        saved = self.batches()
        sums = saved.agg(F.sum("rows").alias("rows"), *[F.sum(x).cast("decimal(38,0)").alias(x) for x in LANES])
        schema = saved.select("schema").first().schema
        return profile.sealed(sums, schema)
