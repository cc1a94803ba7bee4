"""BM25 ranking of chunks, within each document or over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_heading, round_half_up, snippet, trim, words
from ..sources.shared import new_path, written

K1, B = 1.5, 0.75


def postings(chunks: DataFrame, text: str, corpus: list[str], key: str) -> DataFrame:
    """(corpus, key, term, tf, dl). Only terms are shuffled, summed before the exchange."""
    terms = chunks.select(*corpus, key, words(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    return terms.select(*corpus, key, "dl", F.explode("w").alias("term")).groupBy(*corpus, key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(chunks: DataFrame, text: str, corpus: list[str]) -> DataFrame:
    """Chunks and mean length of each corpus, empty chunks counted."""
    return chunks.groupBy(*corpus).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words(F.col(text)))).alias("avg_len"))


def idf(chunks: DataFrame, text: str = "text", corpus: list[str] = [], key: str = "chunk_index") -> DataFrame:
    """(corpus, term, df, idf)."""
    df = postings(chunks, text, corpus, key).groupBy(*corpus, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(statistics(chunks, text, corpus).drop("avg_len"), corpus) if corpus else df.withColumn("n", F.lit(chunks.count()))
    return joined.select(*corpus, "term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def search(chunks: DataFrame, queries: DataFrame, text: str = "text", key: str = "chunk_index", k: int = 5, corpus: list[str] = [], fill: bool = True) -> DataFrame:
    """queries: (query_id, query). (corpus, query_id, rank, key, score, header, snippet).

    Only chunks that hold a query's word are scored; the query's words are few, so they are
    broadcast against the postings. With ``fill``, chunks without a hit follow in order of key
    until k are returned; those candidates are the k first chunks of a corpus, never all pairs.
    Blank queries return nothing, nor does a corpus without words. Of one query and corpus at most
    k rows leave each task: the top k is an aggregate with partial results.
    """
    asked = queries.select("query_id", words(trim(F.coalesce(F.col("query"), F.lit("")))).alias("q")).where(F.size("q") > 0)
    terms = asked.select("query_id", F.explode("q").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    # Written: lengths, frequencies and weights are found from words that are cut once.
    split = written(chunks.select(*corpus, key, words(F.col(text)).alias("w")).withColumn("dl", F.size("w")), new_path(chunks.sparkSession, "chunk-words"))
    total = split.groupBy(*corpus).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_len")).where("avg_len > 0")
    wanted = terms.select("term").distinct()
    tf = split.select(*corpus, key, "dl", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy(*corpus, key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*corpus, "term").agg(F.count(F.lit(1)).alias("df"))
    one = None if corpus else total.first()
    held = df.join(total, corpus) if corpus else df.withColumn("n", F.lit(one["n"] if one else 0)).withColumn("avg_len", F.lit(one["avg_len"] if one else 1.0))
    weight = held.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    hit = tf.join(weight, [*corpus, "term"]).join(terms, "term")
    score = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    scored = hit.groupBy(*corpus, "query_id", key).agg(F.sum(score).alias("s"))
    if fill:
        # The first k chunks of every corpus, offered with no score to every query.
        lead = _first(split, corpus, key, k)
        if corpus:
            offered = lead.join(total, corpus, "left_semi").crossJoin(asked.select("query_id"))
        else:
            keys = [r[key] for r in lead.collect()] if one else []
            offered = asked.select("query_id", F.explode(F.lit(keys).cast(f"array<{dict(chunks.dtypes)[key]}>")).alias(key)) if keys else None
    if fill and offered is not None:
        scored = scored.unionByName(offered.select(*corpus, "query_id", key, F.lit(0.0).alias("s"))).groupBy(*corpus, "query_id", key).agg(F.sum("s").alias("s"))
    top = _top(scored, [*corpus, "query_id"], F.struct((-round_half_up(F.col("s"), 9)).alias("far"), F.col(key)), k)
    top = top.select(*corpus, "query_id", F.posexplode("top").alias("pos", "t")).select(*corpus, "query_id", (F.col("pos") + 1).alias("rank"), F.col(f"t.{key}").alias(key), (-F.col("t.far")).alias("s"))
    shown = chunks.select(*corpus, key, first_heading(F.col(text)).alias("header"), snippet(F.col(text)).alias("snippet"))
    return top.join(shown, [*corpus, key]).select(*corpus, "query_id", "rank", key, round_half_up(F.col("s"), 4).alias("score"), "header", "snippet")


def _top(rows: DataFrame, by: list[str], item, k: int) -> DataFrame:
    """The k least items of each group. Groups are cut into salted parts first, so no task sorts
    one group's rows alone."""
    parts = rows.select(*by, F.pmod(F.xxhash64(item), F.lit(32)).alias("_salt"), item.alias("_i"))
    part = parts.groupBy(*by, "_salt").agg(F.slice(F.sort_array(F.collect_list("_i")), 1, k).alias("_t"))
    return part.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_t"))), 1, k).alias("top"))


def _first(rows: DataFrame, corpus: list[str], key: str, k: int) -> DataFrame:
    if not corpus:
        return rows.select(key).orderBy(key).limit(k)
    return _top(rows, corpus, F.struct(key), k).select(*corpus, F.explode("top").alias("_t")).select(*corpus, F.col(f"_t.{key}").alias(key))
