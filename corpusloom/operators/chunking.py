"""Header chunks, token-budget splits and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter
from ..functions.config import MAX_TOKENS, OVERLAP, RESPLIT_OVER
from ..functions.text import blocks, first_heading, is_blank, text_or_empty, units

HEAD = r"#{1,3}\s+"


def header_blocks(body: Column) -> Column:
    return F.when(is_blank(text_or_empty(body)), F.array().cast("array<string>")).otherwise(blocks(body, HEAD))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n+"), lambda p: ~is_blank(p))


def fold(parts: Column, budget: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """parts: array of (p, t) with t the tokens of paragraph p. Greedy groups within the budget; a
    short last paragraph is carried into the next group. Array of arrays of paragraphs."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<struct<p:string,t:int>>").alias("now"), F.lit(0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["sum"] + x["t"] > budget) & (F.size(acc["now"]) > 0)
        last = F.try_element_at(acc["now"], F.lit(-1))
        carry = over & (last["t"] < overlap * 1.5)
        names = F.transform(acc["now"], lambda y: y["p"])
        base = F.when(over, F.when(carry, F.array(last)).otherwise(F.filter(acc["now"], lambda y: F.lit(False)))).otherwise(acc["now"])
        total = F.when(over, F.when(carry, last["t"]).otherwise(F.lit(0))).otherwise(acc["sum"])
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(names))).otherwise(acc["done"]).alias("done"),
            F.concat(base, F.array(x)).alias("now"),
            (total + x["t"]).alias("sum"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.transform(acc["now"], lambda y: y["p"])))).otherwise(acc["done"])

    return F.aggregate(parts, start, step, finish)


def chunk(docs: DataFrame, markdown: str = "markdown", counter: Callable[[Column], Column] = units, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """keys, chunk_index, header, text, token_count, oversized_resplit. The paragraphs of chunks beyond the
    budget are grouped by chunk, and chunks are numbered within their document: two shuffles by key."""
    return chunk_parsed(frontmatter.parse(docs, markdown, general=False), counter, keys)


def chunk_parsed(parsed: DataFrame, counter: Callable[[Column], Column] = units, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """``chunk`` of documents whose frontmatter is parsed; keys may hold columns that go by document."""
    body = parsed.select(*keys, header_blocks(F.col("body")).alias("_b"))
    one = body.select(*keys, F.posexplode("_b").alias("_sec", "_text")).withColumn("_tokens", counter(F.col("_text")))
    split = one.where(F.col("_tokens") > RESPLIT_OVER).select(*keys, "_sec", "_text", F.posexplode(paragraphs(F.col("_text"))).alias("_i", "_p"))
    # Tokens of paragraphs are counted in rows, where a vectorised counter can run.
    split = split.withColumn("_pt", counter(F.col("_p")))
    groups = split.groupBy(*keys, "_sec").agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_p").alias("p"), F.col("_pt").alias("t")))).alias("_ps"), F.first("_text").alias("_text"))
    pieces = groups.withColumn("_g", fold(F.transform("_ps", lambda x: F.struct(x["p"].alias("p"), x["t"].cast("int").alias("t")))))
    pieces = pieces.select(*keys, "_sec", first_heading(F.col("_text")).alias("header"), F.posexplode("_g").alias("_sub", "_parts"))
    pieces = pieces.withColumn("text", F.array_join("_parts", "\n\n")).select(*keys, "_sec", "_sub", "header", "text", counter(F.col("text")).alias("token_count"), F.lit(True).alias("oversized_resplit"))
    whole = one.where(F.col("_tokens") <= RESPLIT_OVER).select(*keys, "_sec", F.lit(0).alias("_sub"), first_heading(F.col("_text")).alias("header"), F.col("_text").alias("text"), F.col("_tokens").alias("token_count"), F.lit(False).alias("oversized_resplit"))
    from pyspark.sql.window import Window

    every = whole.unionByName(pieces)
    return every.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*keys).orderBy("_sec", "_sub")) - 1).drop("_sec", "_sub")


def summarize(chunks: DataFrame, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("oversized_resplit").alias("oversized_resplit"),
        F.max("token_count").alias("max_tokens"),
        F.min("token_count").alias("min_tokens"),
        (F.floor(F.avg("token_count") * 10 + 0.5) / 10).alias("avg_tokens"),
    )
