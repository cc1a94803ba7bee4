"""Quality rules from cross-document line frequency.

Lines are normalised and hashed; for every host the distinct documents that hold a line are
counted; lines above the limits are removed and documents that lose too much are rejected.

Only DataFrame functions are used. One shuffle carries (host, line, content) hashes, never text:
the count is a two-step aggregate, so a host or a line that holds a third of all rows is
pre-aggregated in every map task. The lines above the limits are few by construction: a line must
be in ``share`` of its host's documents, so a host has at most (lines per document / share) of
them. They are broadcast only after their number has been counted.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its
own; rows that repeat a text count once towards a line's documents, so exact copies never turn a
text into boilerplate; rows repeating a doc_id each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, has_word, materialize, words_of


@dataclass(frozen=True)
class Limits:
    """A line goes if more than max(docs, share * documents of the host) documents hold it;
    a document is rejected if more than ``lost`` of its words stood in such lines."""

    docs: int = 8
    share: float = 0.01
    lost: float = 0.6
    #: Whether exact copies of a text count as so many documents. Once each by default: else the lines of
    #: a large group of copies would all go, and no copy be left.
    each_copy: bool = False
    #: Lines above the limits, over all hosts, up to which they are broadcast.
    broadcast_lines: int = 200_000


def normal_line(line: Column) -> Column:
    """Lower case, one space between words, every number as 0."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, f"{WHITE}+", " "), "[0-9]+", "0")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed_lines(text: Column) -> Column:
    """Hash of each normalised line in order; 0 stands for a line without a word."""
    return F.transform(_lines(text), lambda x: F.when(has_word(x), F.xxhash64(normal_line(x))).otherwise(F.lit(0).cast("long")))


def frequent_lines(docs: DataFrame, text: str, host: str, limits: Limits) -> DataFrame:
    """(host, hashes): for each host the lines above the limits; hosts without any are absent."""
    base = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), (F.monotonically_increasing_id() if limits.each_copy else F.xxhash64(text)).alias("content"), F.col(text).alias("body")).where(F.col("body").isNotNull())
    held = base.select("host", "content", F.explode(F.array_distinct(F.concat(_hashed_lines(F.col("body")), F.array(F.lit(0).cast("long"))))).alias("line"))
    # Line 0 is in every document: its count is the number of documents of the host.
    counts = held.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    # A line within the limit for any host can be dropped before hosts are compared. The few rows left of
    # each task are put together: a file for each task would cost its writer more than the rows do.
    files = docs.sparkSession.sparkContext.defaultParallelism
    counts = materialize(counts.where((F.col("docs") > limits.docs) | (F.col("line") == 0)).repartition(files), "line-counts")
    total = counts.where("line = 0").select("host", F.col("docs").alias("of"))
    above = counts.where("line <> 0").join(total, "host").where(F.col("docs") > F.greatest(F.lit(float(limits.docs)), F.col("of") * limits.share))
    return materialize(above.groupBy("host").agg(F.collect_set("line").alias("hashes")).repartition(files), "frequent-lines")


def _base(row: DataFrame) -> DataFrame:
    """row has text and host; adds the counts of the base rules."""
    one = row.withColumn("w", words_of(F.col("text"))).withColumn("ls", F.filter(_lines(F.col("text")), has_word))
    text = F.coalesce(F.col("text"), F.lit(""))
    two = one.select(
        *row.columns,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.when(
                F.size("w") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        ).alias("g"),
    )
    g = F.col("g")
    # Windows that have an equal neighbour in hash order, by position.
    again = F.filter(g, lambda x, k: (x["h"] == F.coalesce(F.get(g, k - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get(g, k + 1)["h"], F.bitwise_not(x["h"]))))
    three = two.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("g")
    at = F.col("at")
    covered = F.when(F.size(at) == 0, F.lit(0)).otherwise(3 + F.aggregate(F.transform(at, lambda p, k: F.when(k == 0, F.lit(0)).otherwise(F.least(F.lit(3), p - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x))
    four = three.withColumn("n_repeat_words", covered.cast("long")).drop("at")
    return four.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of docs: ``row`` (all its columns), the base counts, lost_words,
    clean_text (without the lines above the limits; null stays null), base_failed and kept."""
    above = frequent_lines(docs, text, host, limits)
    size = above.agg(F.sum(F.size("hashes"))).first()[0] or 0
    above = above.withColumnRenamed("host", "at_host")
    # Counted just now, so a broadcast is of a known size; beyond the bound Spark shuffles by host.
    above = F.broadcast(above) if size <= limits.broadcast_lines else above
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    row = row.join(above, F.col("host") == F.col("at_host"), "left")
    hashes = F.coalesce(F.col("hashes"), F.array().cast("array<bigint>"))
    row = row.withColumn("gone", F.when(F.size(hashes) == 0, F.array().cast("array<boolean>")).otherwise(F.transform(_hashed_lines(F.col("text")), lambda h: F.array_contains(hashes, h))))
    gone = F.col("gone")
    row = row.withColumn("any_gone", F.exists(gone, lambda x: x))
    left = F.filter(_lines(F.col("text")), lambda _, k: ~F.coalesce(F.get(gone, k), F.lit(False)))
    row = row.withColumn("clean_text", F.when(F.col("any_gone"), F.array_join(left, "\n")).otherwise(F.col("text"))).drop("host", "at_host", "hashes", "gone")
    out = _base(row)
    lost = F.when(F.col("any_gone"), F.col("n_words") - F.size(words_of(F.col("clean_text")))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("lost_words", lost)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= limits.lost * F.col("n_words"))).drop("text", "any_gone")


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits(), size: str | None = "n_chars") -> DataFrame:
    """The kept rows with the columns of docs, without the lines above the limits; column
    ``size`` (if docs has it) becomes the new number of characters."""
    # A row number keeps the filter where it is: pushed below, it would repeat the whole judgement.
    judged = judge(docs, text, host, limits).withColumn("at", F.monotonically_increasing_id()).where("kept and at >= 0")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: F.col("clean_text")}
    if size in docs.columns:
        out[size] = F.length("clean_text").cast(docs.schema[size].dataType)
    return judged.select(*[v.alias(k) for k, v in out.items()])


def op1_line_frequency(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


#: The same rows in DuckDB. Lines are compared as text; the limits are those of Limits().
SQL_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, host, t, text, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ')) AS norm,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM l),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
above AS (SELECT n.host, norm FROM n JOIN hosts USING (host) WHERE nw > 0 GROUP BY n.host, norm, docs
  HAVING count(DISTINCT n.t) > 8 AND count(DISTINCT n.t) > docs * 0.01),
per AS (SELECT n.r, sum(nw) FILTER (a.norm IS NOT NULL) AS lost,
  count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS n_dup_lines
  FROM n LEFT JOIN above a ON a.host = n.host AND a.norm = n.norm AND nw > 0 GROUP BY n.r),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM g),
cover AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY r),
s AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost_words
  FROM w LEFT JOIN per USING (r) LEFT JOIN cover USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.6 * n_words AS kept
FROM s
"""
