"""Markdown files that arrive in a folder, kept as a set of documents by name.

Each micro-batch of a file stream is one upsert: a name that is there is replaced in its place, others are
appended. A batch is written under a name of its own, then a manifest of its number appears, whole and
only where none is; so a batch that is run again, after a failure or beside a late attempt, changes
nothing. What no manifest names is never read. ``compact`` folds the batches so far into one table, from
which later reads begin.

Defined cases: of one name the last row wins by (batch, ord, markdown); places that tie are sorted by
name; a null name is a name; files that are no markdown are passed over; an empty batch is a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..sources.corpus import is_markdown
from ..sources.versions import VersionedTable

SCHEMA = "name string, markdown string, batch bigint, ord bigint, place_batch bigint, place_ord bigint"


class DocumentSet:
    """Documents by name at a path, changed by numbered batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.batches, self.folded = VersionedTable(spark, self.path, "name"), VersionedTable(spark, f"{self.path}/folded", "name")

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """rows: (ord, name, markdown). False if the batch was applied before."""
        if any(r["version"] == batch for r in self.batches.log()):
            return False
        data, n = uuid.uuid4().hex, F.lit(batch).cast("bigint")
        own = rows.select(F.col("name").cast("string"), F.col("markdown").cast("string"), n.alias("batch"), F.col("ord").cast("bigint"), n.alias("place_batch"), F.col("ord").cast("bigint").alias("place_ord"))
        own.write.option("compression", "zstd").parquet(f"{self.path}/data/{data}")
        return self.batches._appear(batch, {"version": batch, "data": data, "base": None, "kind": "batch", "undoes": None})

    def current(self, until: int | None = None) -> DataFrame:
        """(place_batch, place_ord, name, markdown) after the batches up to ``until``."""
        start = max(self.folded.log(until), key=lambda r: r["version"], default=None)
        names = [f"{self.path}/data/{r['data']}" for r in [*([start] if start else []), *(r for r in self.batches.log(until) if not start or r["version"] > start["version"])]]
        rows = self.spark.read.schema(SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], SCHEMA)
        return _upserted(rows).select("place_batch", "place_ord", "name", "markdown")

    def compact(self) -> int | None:
        """Fold the batches so far; the last one folded. Reads as of earlier batches go on from earlier folds."""
        last = max((r["version"] for r in self.batches.log()), default=None)
        if last is None or any(r["version"] == last for r in self.folded.log()):
            return last
        done = max((r["version"] for r in self.folded.log()), default=None)
        names = [r["data"] for r in self.folded.log() if r["version"] == done] + [r["data"] for r in self.batches.log(last) if done is None or r["version"] > done]
        data = uuid.uuid4().hex
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{x}" for x in names])
        _upserted(rows).write.option("compression", "zstd").parquet(f"{self.path}/data/{data}")
        self.folded._appear(last, {"version": last, "data": data, "base": done, "kind": "fold", "undoes": None})
        return last


def _upserted(rows: DataFrame) -> DataFrame:
    """One row a name: its last text, its first place."""
    last, first = F.max(F.struct("batch", "ord", "markdown")).alias("l"), F.min(F.struct("place_batch", "place_ord")).alias("f")
    return rows.groupBy("name").agg(last, first).select("name", "l.markdown", "l.batch", "l.ord", "f.place_batch", "f.place_ord")


def watch(spark: SparkSession, folder: str, target: DocumentSet, checkpoint: str, files_each: int = 10_000) -> DataStreamWriter:
    """A writer, to be given a trigger and started, that applies what arrives in a folder to a document
    set. Files of a batch are in the order of their times."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_each).schema("value string").text(folder, wholetext=True)
    rows = files.select(F.unix_micros("_metadata.file_modification_time").alias("ord"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("markdown")).where(is_markdown(F.col("name")))

    def upsert(batch: DataFrame, number: int) -> None:
        target.apply(batch, number)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
