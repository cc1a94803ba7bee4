"""Shared helpers: the written cut of a lineage, and expressions for words and lines."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ready

#: Long words of a filter of keys: 32 MB at most.
FILTER = 1 << 22

#: White space that ends a word; every other character belongs to one.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master (tests) gets a
    folder of our own; on a cluster, whose executors would not see it, this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of whole texts by their bytes; rows of a few numbers stay many to a batch."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864", "67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    The rows survive lost executors, nothing upstream runs twice, and the planner
    knows the size of what it reads.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that an earlier round of an iteration wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written on the way to a result, to be dropped once it is written itself."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.made = spark, []
        bounded_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``materialize``."""
        self.made.append(new_path(self.spark, name))
        # Hashes and bits, hardly two alike: dictionaries and strong compression cost more than they save.
        df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(self.made[-1])
        return self.spark.read.schema(df.schema).parquet(self.made[-1])

    def forget(self, name: str) -> None:
        """Drop the tables of that name; nothing that is still to run reads them."""
        for path in [x for x in self.made if x.rsplit("/", 1)[-1].startswith(f"{name}-")]:
            delete(self.spark, path)
            self.made.remove(path)

    def drop(self) -> None:
        for path in self.made:
            delete(self.spark, path)
        self.made.clear()


def map_pandas(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Like mapInPandas, but whole numbers stay whole: a column of them that holds a null arrives as
    Python objects, where pandas would make doubles of it and round ids beyond 2**53."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batch.to_pandas(integer_object_nulls=True) for batch in batches):
            yield pa.RecordBatch.from_pandas(out, schema=wanted, preserve_index=False)

    return df.mapInArrow(through, schema)


def counted(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table of few narrow columns, broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def among(keys: DataFrame) -> Callable[[Column], Column]:
    """keys: one column of hashes. A test of a column of hashes that all of them pass and few others do,
    so that rows without a partner need not be shuffled for a join. One bit stands for each key in a table
    of bounded size; far beyond its bound, hashes that are no keys pass too, which costs time and no result."""
    spark = keys.sparkSession
    size, number, key = 1 << 10, keys.count(), keys.columns[0]
    while size < FILTER and size < number:
        size *= 2
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{key}`, 58) as int))")
    found = keys.groupBy(F.pmod(key, F.lit(size)).cast("int").alias("k")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(size, np.int64)
    table[found["k"].to_numpy()] = found["b"].to_numpy()
    kept = spark.sparkContext.broadcast(table)

    def test(hashes: pd.Series) -> pd.Series:
        number = hashes.to_numpy(np.int64)
        return pd.Series((kept.value[number % size] >> (number.view(np.uint64) >> np.uint64(58)).astype(np.int64)) & 1 == 1)

    return lambda hashes: F.pandas_udf(test, "boolean")(hashes)


def words_of(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def learnt_from(doc_id: Column) -> Column:
    """True for rows that a model may learn from: three of four, by the checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def held_out(doc_id: Column) -> Column:
    return ~learnt_from(doc_id)
