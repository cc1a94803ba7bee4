"""Connected components of an edge table that never leaves the executors.

Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows
with the logarithm of the longest path. Each half round is an aggregate with map-side combine and
a join of two written tables, so a hub's edges can be split by the adaptive planner. Every round
is written to the shared folder and the round before it is deleted. A graph that has been counted
to have at most ``SMALL`` edges is settled by one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path

SMALL = 1_000_000


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo") % 1000003)).first())


def _half(edges: DataFrame, large: bool, made: list[str]) -> DataFrame:
    """One half round over (hi, lo), hi > lo."""
    spark = edges.sparkSession
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    made.append(new_path(spark, "cc-least"))
    least = _write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), made[-1])
    met = both.join(least, "u")
    out = met.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")) if large else met.select("v", "m").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    made.append(new_path(spark, "cc-edges"))
    return _write(out.distinct(), made[-1])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (hi, lo) of the graph."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    hi, lo = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.r_[hi, lo], return_inverse=True)
    a, b, root = at[: len(hi)], at[len(hi) :], np.arange(len(nodes))
    while True:
        was = root.copy()
        least = np.minimum(root[a], root[b])
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, least)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(was, root):
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the smallest
    node reachable. Nodes are longs; nulls and loops are dropped; repeated edges do no harm."""
    spark = edges.sparkSession
    made = [new_path(spark, "cc-edges")]
    now = _write(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), made[0])
    was = _digest(now)
    if was[0] <= SMALL:
        return now.select("hi", "lo").coalesce(1).mapInArrow(_settled, "node long, root long")
    for _ in range(rounds):
        if not was[0]:
            break
        now = _half(_half(now, True, made), False, made)
        for path in made[:-1]:
            delete(spark, path)
        del made[:-1]
        digest = _digest(now)
        if digest == was:
            break
        was = digest
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
