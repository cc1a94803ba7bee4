"""BM25 over a stored index: postings written once, searched with block maxima.

``build`` writes Parquet tables below a folder: ``chunks`` (length, heading, snippet, words counted in
their row), ``corpora`` (number and mean length), ``terms`` (df, idf) and ``blocks``. Chunks of like length
share a stripe of about ``PER_STRIPE``; a block has the postings of one word in one stripe with their
weights but for the idf, and the largest of these. Blocks are partitioned by a hash of the word, sorted by
word in the files. Postings are shuffled once. Stripes are dealt to parts of about ``PART`` chunks.

``search`` shuffles the blocks of the queries' words by part; what queries and chunks make of them, a
product of two matrices, stays within the part's task, and of each query and part at most k rows leave it.
Large corpora are first asked for words, stripes and maxima alone: the sum of a query's maxima over a
stripe bounds the score of every chunk in it. The stripes of the highest bounds are scored; the k-th score
found there is one that k chunks reach, so stripes bounded below it for all queries are never read. The
others are scored in full, which makes the result exact: the same rows as a scan of all postings. Corpora
of a few stripes are scored at once, as the first stripes would be nearly all of theirs.

Defined cases: texts without words are in no block but can fill up a result; a corpus without words
and a blank query give nothing; null texts are empty; an empty table gives an index without results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import counted_words, first_heading, round_half_up, snippet, trim, words
from ..sources.shared import new_path, written
from .retrieve import B, K1, _top

#: Chunks of a stripe on average, folders that words are dealt to, stripes scored for the first bound.
PER_STRIPE, BUCKETS, SEEDS = 8, 32, 16
#: Query ids that one literal holds.
IDS = 10_000
#: Chunks whose blocks meet in one task on average, and queries that they are multiplied with at a time.
PART, TOGETHER = 512, 256
#: Chunks of a corpus on average up to which all stripes are scored at once.
SMALL = 2 * PER_STRIPE * SEEDS
SLACK = 1e-9


@dataclass
class Index:
    """The tables of a folder that ``build`` wrote."""

    chunks: DataFrame
    corpora: DataFrame
    terms: DataFrame
    blocks: DataFrame
    key: str
    corpus: list[str]
    buckets: int

    @property
    def own(self) -> list[str]:
        """Columns that tell corpora apart; a single corpus has a constant."""
        return self.corpus or ["corpus_"]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, path: str, text: str = "text", key: str = "chunk_index", corpus: list[str] = [], per_stripe: int = PER_STRIPE, buckets: int = BUCKETS) -> Index:
    """Write the index of chunks below path, a folder that all executors share, and open it."""
    spark = chunks.sparkSession
    own = corpus or ["corpus_"]
    base = chunks.withColumn(own[0], F.lit(0)) if not corpus else chunks
    body = F.coalesce(F.col(text), F.lit(""))
    split = base.select(*own, key, words(body).alias("w"), first_heading(body).alias("header"), snippet(body).alias("snippet"))
    # What chunks are made by runs once; the words are counted in their row.
    shown = written(split.select(*own, key, F.size("w").alias("dl"), "header", "snippet", counted_words(F.col("w")).alias("words")), f"{path}/chunks")
    corpora = written(shown.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_len")).where("avg_len > 0"), f"{path}/corpora")
    df = shown.select(*own, F.explode("words.term").alias("term")).groupBy(*own, "term").agg(F.count(F.lit(1)).alias("df"))
    # Without corpora these are one row and a few dozen levels of length.
    few = F.broadcast if not corpus else lambda x: x
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    written(df.join(few(corpora), own).select(*own, "term", "df", idf.alias("idf")), f"{path}/terms")
    level = F.floor(F.log2(F.col("dl") + 1) * 4)
    levels = shown.groupBy(*own, level.alias("level")).agg(F.count(F.lit(1)).alias("m"))
    placed = shown.select(*own, key, "dl", "words", level.alias("level")).join(few(corpora), own).join(few(levels), [*own, "level"])
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    stripe = F.col("level") * F.lit(1 << 40) + F.pmod(F.xxhash64(key), F.ceil(F.col("m") / F.lit(per_stripe)))
    placed = placed.withColumn("stripe", stripe).withColumn("part_", F.pmod(F.xxhash64("stripe"), F.ceil(F.col("n") / F.lit(PART))))
    rows = placed.select(*own, F.col(key).alias("key"), "dl", "avg_len", "stripe", "part_", F.inline("words"))
    # A word's blocks go to a few files, so that one of all chunks isn't one task's. The groups lie within
    # what is dealt, so postings are shuffled this once, as counts; weights are hardly two alike and take more room.
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("deal", F.pmod(F.xxhash64("stripe"), F.lit(4)))
    blocks = rows.repartition("bucket", "deal").groupBy("bucket", "deal", *own, "term", "part_", "stripe").agg(F.max(weight).alias("top"), F.collect_list(F.struct("key", weight.alias("weight"))).alias("postings"))
    dealt = blocks.drop("deal").select(*own, "term", "part_", "stripe", "top", "postings", "bucket").sortWithinPartitions("bucket", "term")
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    about = json.dumps({"key": key, "corpus": corpus, "buckets": buckets})
    spark.createDataFrame([(about, dealt.schema.json())], "about string, blocks string").coalesce(1).write.parquet(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    from pyspark.sql.types import StructType

    row = spark.read.parquet(f"{path}/about").first()
    about, schema = json.loads(row["about"]), StructType.fromJson(json.loads(row["blocks"]))
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("chunks"), read("corpora"), read("terms"), spark.read.schema(schema).parquet(f"{path}/blocks"), about["key"], about["corpus"], about["buckets"])


class _Asked:
    """The words of all questions of a search, numbered, and the questions of each: what every task has."""

    def __init__(self, terms: DataFrame) -> None:
        found = terms.where("query_id is not null").toArrow().combine_chunks()
        term, ids = (pa.array(found[c].to_pylist(), found[c].type).dictionary_encode() for c in ("term", "query_id"))
        word = term.indices.to_numpy()
        by = np.argsort(word, kind="stable")
        self.ids, self.queries, self.times = ids.dictionary, ids.indices.to_numpy()[by], found["qf"].to_numpy()[by].astype(float)
        self.start = np.searchsorted(word[by], np.arange(len(term.dictionary) + 1))
        self.words = pa.table({"term": term.dictionary, "word": pa.array(np.arange(len(term.dictionary)), pa.int32()), "asked": pa.array(np.diff(self.start), pa.int64())})

    def counts(self, word: np.ndarray):
        """(first query, its matrix) of some queries at a time: how often each has each of the words."""
        n = self.start[word + 1] - self.start[word]
        row = np.repeat(np.arange(len(word)), n)
        at = np.repeat(self.start[word] - np.cumsum(n) + n, n) + np.arange(len(row))
        query, times = self.queries[at], self.times[at]
        for first in range(0, len(self.ids), TOGETHER):
            here = (query >= first) & (query < first + TOGETHER)
            out = np.zeros((len(word), min(TOGETHER, len(self.ids) - first)))
            out[row[here], query[here] - first] = times[here]
            yield first, out

    def _rows(self, table: pa.Table, own: list[str], found: list[tuple[np.ndarray, ...]], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
        query, *more = (np.concatenate(x) for x in zip(*found))
        same = pa.array(np.zeros(len(query), np.int64))
        columns = {c: table.column(c).take(same) for c in own} | {"query_id": self.ids.take(pa.array(query))}
        return pa.table(columns | {c: pa.array(x, t) for c, x, t in zip(names, more, kinds)})

    def best(self, own: list[str], key: str, k: int):
        """Of a part's blocks, the k best chunks for each query."""

        def run(table: pa.Table) -> pa.Table:
            postings = table.combine_chunks().column("postings").chunk(0)
            flat = postings.flatten()
            size = postings.value_lengths().to_numpy()
            word, column = np.unique(table.column("word").to_numpy(), return_inverse=True)
            chunk, row = np.unique(flat.field("key").to_numpy(zero_copy_only=False), return_inverse=True)
            weight = flat.field("weight").to_numpy() * np.repeat(table.column("idf").to_numpy(), size)
            has = np.bincount(row * len(word) + np.repeat(column, size), weight, len(chunk) * len(word)).reshape(len(chunk), len(word))
            found = []
            for first, times in self.counts(word):
                score = has @ times
                # Equal scores go by the chunks' keys, which are in order.
                top = np.argsort(-np.floor(score * 1e9 + 0.5), axis=0, kind="stable")[:k]
                at, query = np.nonzero(np.take_along_axis(score, top, 0) > 0)
                which = top[at, query]
                found.append((query + first, chunk[which], score[which, query]))
            return self._rows(table, own, found, [key, "s"], [flat.field("key").type, pa.float64()])

        return run

    def bounds(self, own: list[str]):
        """Of a part's blocks without postings, what a chunk of each stripe can reach for each query."""

        def run(table: pa.Table) -> pa.Table:
            word, column = np.unique(table.column("word").to_numpy(), return_inverse=True)
            stripe, row = np.unique(table.column("stripe").to_numpy(), return_inverse=True)
            has = np.zeros((len(stripe), len(word)))
            has[row, column] = table.column("top").to_numpy() * table.column("idf").to_numpy()
            found = []
            for first, times in self.counts(word):
                bound, n = has @ times, (has > 0).astype(float) @ (times > 0)
                at, query = np.nonzero(bound > 0)
                found.append((query + first, stripe[at], bound[at, query], n[at, query].astype(np.int64)))
            return self._rows(table, own, found, ["stripe", "bound", "n"], [pa.int64(), pa.float64(), pa.int64()])

        return run


def search(index: Index, queries: DataFrame, k: int = 5, fill: bool = True, trace: list | None = None) -> DataFrame:
    """queries: (query_id, query). (corpus, query_id, rank, key, score, header, snippet), the rows that
    ``retrieve.search`` gives. ``trace`` gets (blocks that hold a query's word, blocks read in the end)."""
    spark, own, key = queries.sparkSession, index.own, index.key
    asked = queries.select("query_id", words(trim(F.coalesce(F.col("query"), F.lit("")))).alias("q")).where(F.size("q") > 0)
    terms = asked.select("query_id", F.explode("q").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    by = [*own, "query_id"]
    some = _Asked(terms)
    # At most as many folders as there are: partitions of the others are not listed.
    wanted = spark.createDataFrame(some.words)
    folders = [r[0] for r in wanted.select(_bucket(F.col("term"), index.buckets)).distinct().collect()]
    blocks = index.blocks.where(F.col("bucket").isin(folders)).drop("bucket") if folders else index.blocks.limit(0)
    idf = index.terms.join(F.broadcast(wanted), "term").select(*own, "word", "idf")
    known = lambda *more: blocks.join(F.broadcast(wanted), "term").select(*own, "part_", "stripe", "word", *more).join(idf if index.corpus else F.broadcast(idf), [*own, "word"])
    kinds = dict(index.chunks.dtypes) | {"query_id": dict(asked.dtypes)["query_id"]}
    named = ", ".join(f"{c} {kinds[c]}" for c in by)
    scored = lambda hit: hit.groupBy(*own, "part_").applyInArrow(some.best(own, key, k), f"{named}, {key} {kinds[key]}, s double")
    size = index.corpora.agg(F.avg("n")).first()[0] or 0 if index.corpus else None
    alive = None
    if size is None or size > SMALL:
        bounds = known("top").groupBy(*own, "part_").applyInArrow(some.bounds(own), f"{named}, stripe long, bound double, n long")
        bounds = written(bounds, new_path(spark, "stripe-bounds"))
        seeds = _top(bounds, by, F.struct((-F.col("bound")).alias("far"), F.col("stripe")), SEEDS).select(*own, F.explode("top.stripe").alias("stripe")).distinct()
        first = scored(known("postings").join(written(seeds, new_path(spark, "seeds")), [*own, "stripe"], "left_semi"))
        reached = _top(first, by, F.struct((-F.col("s")).alias("far"), F.col(key)), k).where(F.size("top") == k).select(*by, (-F.element_at("top", k)["far"]).alias("least"))
        alive = bounds.join(written(reached, new_path(spark, "reached")), by, "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        stripes = written(alive.select(*own, "stripe").distinct(), new_path(spark, "stripes-alive"))
    if trace is not None:
        # Without bounds all blocks are read.
        met = blocks.join(F.broadcast(wanted), "term").agg(F.sum("asked")).first()[0] or 0 if alive is None else bounds.agg(F.sum("n")).first()[0] or 0
        trace.append((met, met if alive is None else alive.agg(F.sum("n")).first()[0] or 0))
    found = scored(known("postings") if alive is None else known("postings").join(stripes, [*own, "stripe"], "left_semi"))
    if fill:
        # The first k chunks of each corpus, offered with no score to every query: rows of the result
        # wherever fewer than k chunks are hit.
        lead = _top(index.chunks.join(index.corpora, own, "left_semi"), own, F.struct(key), k)
        ids = [r[0] for r in asked.select("query_id").collect()]
        kind = dict(asked.dtypes)["query_id"]
        offers = [lead.select(*own, F.explode(F.lit(ids[at : at + IDS]).cast(f"array<{kind}>")).alias("query_id"), "top") for at in range(0, len(ids), IDS)]
        if offers:
            offered = reduce(DataFrame.unionByName, offers).select(*by, F.explode("top").alias("t")).select(*by, F.col(f"t.{key}").alias(key), F.lit(0.0).alias("s"))
            found = found.unionByName(offered).groupBy(*by, key).agg(F.sum("s").alias("s"))
    top = _top(found, by, F.struct((-round_half_up(F.col("s"), 9)).alias("far"), F.col(key)), k)
    top = top.select(*by, F.posexplode("top").alias("pos", "t")).select(*by, (F.col("pos") + 1).alias("rank"), F.col(f"t.{key}").alias(key), (-F.col("t.far")).alias("s"))
    out = top.join(index.chunks.select(*own, key, "header", "snippet"), [*own, key])
    return out.select(*index.corpus, "query_id", "rank", key, round_half_up(F.col("s"), 4).alias("score"), "header", "snippet")
