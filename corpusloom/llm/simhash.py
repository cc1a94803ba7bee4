"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint. Fingerprints that differ in at most three bits agree on at
least three of six blocks, so every choice of three blocks is a key: close pairs share a key.
Equal fingerprints are collapsed first. Keys with two members or more are verified by Hamming
distance inside Arrow batches. A key with more than ``CHUNK`` members is cut into chunks and every
pair of chunks is a group of its own, so no task holds more than two chunks of one key and no pair
is left out; a group gives only the edges of a spanning forest, never all its pairs. Components
are found by star contraction on the executors.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; rows
repeating a doc_id each give a row and may lie in different components; the component id of rows
whose doc_ids are all null is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import Scratch, counted, map_pandas, materialize, table
from .components import connected_components
from .tokens import shingles

SEED = 42
#: Bits of each of the six blocks, lowest first.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most members of one key in one chunk.
CHUNK = 1024


def _masks(distance: int = 3) -> list[int]:
    """For each choice of blocks that stay equal, its bits as a signed long."""
    starts = np.cumsum((0, *BLOCKS))
    block = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts)]
    found = [sum(block[i] for i in keep) for keep in combinations(range(len(BLOCKS)), len(BLOCKS) - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed long."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(SEED)), np.uint64, n)
    # Eight bit counters in each 64-bit lane; a lane holds 255 rows before it could overflow.
    lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(n, 8)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.fromiter((fingerprint(t, shingle) for t in batch["text"]), np.int64, len(batch))})

    return map_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def forest(end: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their roots, for rows linked to an earlier row of their group.

    Row i's group ends before end[i]. Row i is compared with i + 1, i + 2, ... for all i at once.
    """
    root = np.arange(len(fp))
    at, d = np.arange(len(fp)), 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        hit = hit[root[hit] != root[hit + d]]
        if len(hit):
            for i, j in zip(root[hit].tolist(), root[hit + d].tolist()):
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                root[max(i, j)] = min(i, j)
            while not np.array_equal(up := root[root], root):
                root = up
        d += 1
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return linked, root[linked]


def _verify(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def edges(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows[["key", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            end = np.repeat(np.r_[starts[1:], len(rows)], np.diff(np.r_[starts, len(rows)]))
            fp = rows["fp"].to_numpy()
            a, b = forest(end, fp, distance)
            return pd.DataFrame({"a": fp[a], "b": fp[b]}).drop_duplicates()

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows[["key", "i", "j"]].iloc[-1]
            new = int((~(rows[["key", "i", "j"]] == last).all(axis=1)).sum())  # sorted: the last group is the tail
            held = rows.iloc[new:]
            if new:
                yield edges(rows.iloc[:new])
        if held is not None and len(held):
            yield edges(held)

    return run


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """fps: one column fp of distinct fingerprints. (a, b): a spanning forest of all pairs that
    differ in at most ``distance`` bits, within each key."""
    keyed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(_masks(distance))])).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    met = keyed.join(shared, "key").withColumn("c", F.ceil(F.col("n") / CHUNK).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    met = met.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    met = met.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = met.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInPandas(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    fp = materialize(fingerprints(docs, id_col, text, shingle), "fingerprints")
    first = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    cc = materialize(connected_components(links(first.select("fp"), distance), "a", "b"), "components")
    named = cc.join(first, cc["node"] == first["fp"])
    least = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    mapped = cc.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    every = first.join(mapped, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fp.join(materialize(every, "fingerprint-components"), "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """(doc_id, text_key, root_doc, root_key) for every document that is not the first, by (doc_id,
    text_key), of its group: texts linked over Jaccard similarities of ``similarity`` or more of
    their sets of word shingles. The pigeonhole blocks of the sets' fingerprints give the first
    candidates, which are verified on the sets. Fingerprints of texts that are just similar enough
    differ in more bits than any choice of blocks can select by, so the prefixes of the sets then
    find exactly those links that still join two groups.

    Rows without a doc_id are absent; rows with equal doc_id and text are one document; texts
    without words are equal; a text of fewer words than a shingle is one shingle."""
    found = setjoin.find(docs, partial(shingles, size=shingle), similarity, id_col, text, prints=True)
    scratch, keep = found.scratch, Scratch(docs.sparkSession)
    first = scratch.write(found.heads.groupBy("print").agg(F.min("nid").alias("first")), "distinct-fingerprints")
    close = scratch.write(links(first.select(F.col("print").alias("fp")), distance), "close-fingerprints")
    named = close.join(first.select(F.col("print").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("print").alias("b"), F.col("first").alias("y")), "b")
    same = found.heads.select("print", "nid").join(first, "print").where(F.col("nid") > F.col("first"))
    seeds = named.select(F.greatest("x", "y").alias("later"), F.least("x", "y").alias("earlier")).unionByName(same.select(F.col("nid").alias("later"), F.col("first").alias("earlier")))
    every = setjoin.joined(found, earlier=False, connect=True, seeds=seeds)
    place = found.heads.select("nid", "node", "copies", "doc_id", "text_key").join(setjoin.roots(scratch, every), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    place = scratch.write(place, "rooted-sets")
    heads = place.where("nid = root").select("root", F.col("doc_id").alias("root_doc"), F.col("text_key").alias("root_key"))
    some = place.where("copies > 1 or nid <> root").select("node", "root").join(heads, "root").drop("root")
    some = scratch.write(some, "grouped-sets")
    out = found.places.join(counted(some), "node").where((F.col("doc_id") != F.col("root_doc")) | (F.col("text_key") != F.col("root_key")))
    out = keep.write(out.select("doc_id", "text_key", "root_doc", "root_key"), "near-copies")
    scratch.drop()
    return out


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group of near copies: the first. Of rows with equal doc_id and
    text one stays; rows without a doc_id stay. All columns are kept."""
    gone = materialize(near_copies(docs, id_col, text, **how).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone-copies")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"))
    # Rows equal in both: few, so they are counted before any text moves.
    again = materialize(row.where("own_id is not null").groupBy("own_id", "own_key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("own_id").alias("again_id"), F.col("own_key").alias("again_key")), "repeated-rows")
    left = row.join(counted(gone), (F.col("own_id") == F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left_anti")
    if not again.isEmpty():
        met = left.join(counted(again), (F.col("own_id") == F.col("again_id")) & (F.col("own_key") == F.col("again_key")), "left")
        once = met.where("again_id is not null").groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row")
        return met.where("again_id is null").select("row").unionByName(once).select("row.*")
    return left.select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
