"""Near-duplicate sections: exact TF-IDF cosine pairs across documents, best first.

The naive self-join of all postings grows with the square of every word's frequency. Here equal
texts are collapsed to classes, and the similarity of the last of the best pairs found so far is a
bound t that rises while words are worked off from rare to frequent, a block of frequencies at a time.
A pair of similarity t or more shares a word of both prefixes: words by rarity, cut where the rest has
a norm below t. At the rarest word that it shares, the product of that word's weights and of the norms
of what follows in both is t or more, so of the rows that meet on a word only those are compared in
whole. Early blocks are cheap and lift t; by the time that the words of thousands of sections come up,
most of their postings lie behind the prefixes. A word with more postings than ``CHUNK`` is cut into
chunks by strength and hash; pairs of chunks whose largest members can't reach t are left out, the
others are tasks of their own, each a product of two short columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import STOP_WORDS
from ..functions.text import blocks, counted_words, first_h1, round_half_up, significant_words, units
from ..sources.shared import new_path, written

#: A block of words goes up to so many times the document frequency of the block before.
WIDER = 16
#: Postings of a word that meet in one task; levels of strength that chunks are made of.
CHUNK, LEVELS = 2048, 8
#: Rarest words of a class, and their document frequency at most, that give the first bound.
SEED_WORDS, SEED_DF = 3, 8
#: Rows that a block of several spans may meet in, for each posting and at least; a span alone may have more.
SPEND, SPEND_LEAST = 2, 50_000
#: Pairs to be compared up to which they are broadcast, some 64 bytes each.
MET = 100_000
SLACK = 1e-9


def h1_blocks(body: Column) -> Column:
    """Trimmed blocks that start with an H1; what stands before the first is dropped."""
    return F.filter(blocks(body, r"#[ \t]+"), lambda x: x.rlike(r"\A#[ \t]+"))


def sections(parsed: DataFrame, topic: Column | None = None, counter=units) -> DataFrame:
    """parsed: documents with frontmatter columns and body. One row for each H1 section."""
    topic = F.coalesce(topic if topic is not None else F.col("topic"), F.lit(""))
    rows = parsed.select("doc_index", "doc_name", topic.alias("topic"), F.posexplode(h1_blocks(F.col("body"))).alias("section_index", "text"))
    return rows.select("doc_index", "doc_name", "topic", "section_index", first_h1(F.col("text")).alias("heading"), "text", counter(F.col("text")).alias("token_count"))


def weights(rows: DataFrame, keys: list[str], text: str = "text", stop: list[str] = STOP_WORDS) -> DataFrame:
    """(keys, term, tf, df, w): raw frequency times ln((n+1)/(df+1))+1 over all rows."""
    tf = rows.select(*keys, F.explode(significant_words(F.col(text), stop)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(df, "term").withColumn("n", F.lit(rows.count()))
    return joined.select(*keys, "term", "tf", "df", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def class_of(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _classes(rows: DataFrame, stop: list[str]) -> DataFrame:
    """rows: (at, text). (id, class, copies, words) of the distinct texts, numbered: postings go by short
    numbers, in order where they are made. A class is one row, so its words are counted there."""
    classes = rows.select(class_of("text").alias("class"), "text").groupBy("class").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    numbered = classes.select(F.monotonically_increasing_id().alias("id"), "class", "copies", counted_words(significant_words(F.col("text"), stop)).alias("words"))
    return written(numbered, new_path(rows.sparkSession, "text-classes"))


def _postings(classes: DataFrame) -> DataFrame:
    """(class, term, df, u, rest, k) of numbered classes: weight in the unit vector, norm squared of the
    words after it by (df, term), and its place among the words that others may share. Document
    frequencies count all rows, copies included; words of one row only are left out."""
    tf = classes.select(F.col("id").alias("class"), "copies", F.inline("words"))
    df = tf.groupBy("term").agg(F.sum("copies").alias("df"))
    # Counts are shuffled and weights found after: hardly two of these are alike.
    counted = tf.join(df, "term").select("class", "term", "df", "tf").repartition("class").withColumn("n", F.lit(classes.agg(F.sum("copies")).first()[0] or 0))
    w = counted.select("class", "term", "df", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    own = Window.partitionBy("class")
    # From the frequent end, so that sums of what follows are running sums.
    after = own.orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, -1)
    shared = (F.col("df") > 1).cast("int")
    u = w.select("class", "term", "df", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))).alias("u"), F.sum(shared).over(own).alias("n"))
    rest, later = F.coalesce(F.sum(F.col("u") * F.col("u")).over(after), F.lit(0.0)), F.coalesce(F.sum(shared).over(after), F.lit(0))
    return u.select("class", "term", "df", "u", rest.alias("rest"), (F.col("n") - later).alias("k")).where("df > 1")


def _meet(p: DataFrame, t: float, hot: bool) -> DataFrame:
    """(x, y): classes with a posting of p in common at which a similarity of t is in reach."""
    p = p.where((F.col("u") * F.col("u") + F.col("rest")) >= (t - SLACK) ** 2).select("term", "class", "u", F.sqrt("rest").alias("r"))
    side = lambda df, c: df.select("term", F.col("class").alias(c), F.col("u").alias(f"u_{c}"), F.col("r").alias(f"r_{c}"))
    reach = F.col("u_x") * F.col("u_y") + F.col("r_x") * F.col("r_y") >= t - SLACK
    cold = p
    if hot:
        n = p.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
        n = written(n, new_path(p.sparkSession, "hot-words"))
        hot = not n.isEmpty()
    if hot:
        cold = p.join(n, "term", "left_anti")
    met = side(cold, "x").join(side(cold, "y"), "term").where((F.col("x") < F.col("y")) & reach).select("x", "y")
    return met.unionByName(_meet_in_chunks(p.join(n, "term"), t)) if hot else met


def _meet_in_chunks(p: DataFrame, t: float) -> DataFrame:
    """The same for words of many postings, with n of them each."""
    level = F.least(F.floor(F.sqrt(F.col("u") * F.col("u") + F.col("r") * F.col("r")) * LEVELS), F.lit(LEVELS))
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / F.lit(CHUNK)))
    p = p.withColumn("chunk", level * F.lit(1 << 40) + salt)
    chunks = p.groupBy("term", "chunk").agg(F.max("u").alias("u"), F.max("r").alias("r"))
    one = lambda c: chunks.select("term", F.col("chunk").alias(c), F.col("u").alias(f"u_{c}"), F.col("r").alias(f"r_{c}"))
    both = one("i").join(one("j"), "term").where("i <= j").where(F.col("u_i") * F.col("u_j") + F.col("r_i") * F.col("r_j") >= t - SLACK).select("term", "i", "j")
    member = p.select("term", "chunk", "class", "u", "r")
    side = lambda c, k: member.withColumnRenamed("chunk", c).join(both, ["term", c]).select("term", "i", "j", F.lit(k).alias("side"), "class", "u", "r")
    left, right = side("i", 0), side("j", 1)

    def product(table: pa.Table) -> pa.Table:
        """Both sides of a pair of chunks are at most a few thousand rows."""
        first = table.column("side").to_numpy() == 0
        name, u, r = (table.column(c).to_numpy() for c in ("class", "u", "r"))
        near = np.outer(u[first], u[~first]) + np.outer(r[first], r[~first]) >= t - SLACK
        a, b = np.nonzero(near)
        x, y = name[first][a], name[~first][b]
        # Within one chunk each pair stands twice, and each class beside itself.
        alike = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        keep = x < y if alike else x != y
        x, y = x[keep], y[keep]
        return pa.table({"x": pa.array(np.where(x < y, x, y)), "y": pa.array(np.where(x < y, y, x))})

    return left.unionByName(right).groupBy("term", "i", "j").applyInArrow(product, "x long, y long")


def _rising(spark, postings: DataFrame, heads: DataFrame, threshold: float, most: int, trace: list) -> list:
    """The best pairs of classes (x, y, similarity, a, b), at most ``most``."""
    p = written(postings, new_path(spark, "postings"))
    h = lambda k, c: heads.select(F.col("class").alias(k), F.col("one").alias(f"{c}1"), F.col("two").alias(f"{c}2"))
    # The least pair of members in different documents.
    options = F.filter(F.array(*[F.struct(F.least(F.col(i), F.col(j)).alias("a"), F.greatest(F.col(i), F.col(j)).alias("b")) for i in ("p1", "p2") for j in ("q1", "q2")]), lambda z: z["a"].isNotNull() & z["b"].isNotNull() & (z["a"]["doc"] != z["b"]["doc"]))
    found: dict[tuple, object] = {}
    t = threshold

    def take(pairs: DataFrame) -> None:
        """Keep the best of (x, y, sim, a, b) and of those before, and raise the bound."""
        nonlocal t, found
        new = pairs.withColumn("similarity", round_half_up(F.col("sim"), 4)).select("x", "y", "similarity", "a", "b").orderBy(F.desc("similarity"), "a", "b").limit(most)
        found |= {(r["x"], r["y"]): r for r in new.collect()}
        found = dict(sorted(found.items(), key=lambda kv: (-kv[1]["similarity"], kv[1]["a"], kv[1]["b"]))[:most])
        if len(found) == most:
            # Order and cap go by rounded similarity: all pairs that round to the last one's or more count.
            t = max(threshold, list(found.values())[-1]["similarity"] - 6e-5)

    copies = heads.where("two is not null").join(p.select("class").distinct(), "class", "left_semi")
    take(copies.select(F.col("class").alias("x"), F.col("class").alias("y"), F.lit(1.0).alias("sim"), F.col("one").alias("a"), F.col("two").alias("b")))
    seen = None
    total, largest = p.agg(F.count(F.lit(1)), F.max("df")).first()
    lows = [1]
    while lows[-1] * WIDER < (largest or 0):
        lows.append(lows[-1] * WIDER)
    seeded = False
    while lows:
        # Rows in which each span of words would meet at the present bound.
        span = sum((F.col("df") > low).cast("int") for low in lows[1:]) if len(lows) > 1 else F.lit(0)
        inside = p.where((F.col("df") > lows[0]) & ((F.col("u") * F.col("u") + F.col("rest")) >= (t - SLACK) ** 2)).groupBy("term", "df").agg(F.count(F.lit(1)).alias("n"))
        cost = {r["span"]: r["c"] for r in inside.groupBy(span.alias("span")).agg(F.sum(F.col("n") * F.col("n")).alias("c")).collect()}
        spent, n = cost.get(0, 0), 1
        while n < len(lows) and spent + cost.get(n, 0) <= max(SPEND * total, SPEND_LEAST):
            spent, n = spent + cost.get(n, 0), n + 1
        seed = not seeded and n < len(lows) and t == threshold
        seeded = True
        low, high = lows[0], SEED_DF if seed else lows[n] if n < len(lows) else largest
        lows = lows if seed else lows[n:]
        if not spent:
            continue
        block = p.where((F.col("df") > low) & (F.col("df") <= high))
        met = _meet(block.where(F.col("k") <= SEED_WORDS) if seed else block, t, hot=high > CHUNK).distinct()
        met = written(met if seen is None else met.join(seen, ["x", "y"], "left_anti"), new_path(spark, "met"))
        compared = met.count()
        trace.append((low, high, t, compared))
        if not compared:
            continue
        seen = met if seen is None else seen.unionByName(met)
        # Postings of the classes that met alone: where those are few, no others are shuffled.
        both = met.select(F.explode(F.array("x", "y")).alias("class")).distinct()
        few = compared <= MET
        if few:
            met, both = F.broadcast(met), F.broadcast(written(both, new_path(spark, "met-classes")))
        mine = p.join(both, "class", "left_semi").select("class", "term", "u")
        if few:
            mine = written(mine, new_path(spark, "met-postings"))
        a, b = (mine.select(F.col("class").alias(x), "term", F.col("u").alias(f"u{z}")) for x, z in (("x", "a"), ("y", "b")))
        sims = a.join(met, "x").join(b, ["y", "term"]).groupBy("x", "y").agg(F.sum(F.col("ua") * F.col("ub")).alias("sim")).where(F.col("sim") >= t)
        # least() skips nulls: an option with a missing member would name one twice, in one document.
        placed = sims.join(h("x", "p"), "x").join(h("y", "q"), "y").withColumn("least", F.array_min(options)).where("least is not null")
        take(placed.select("x", "y", "sim", F.col("least.a").alias("a"), F.col("least.b").alias("b")))
    return list(found.values())


def candidate_pairs(rows: DataFrame, threshold: float = 0.12, most: int = 80, stop: list[str] = STOP_WORDS, trace: list | None = None) -> DataFrame:
    """rows: (doc_index, section_index, text). The ``most`` best pairs of sections of different
    documents: pair_id, a_doc, a_sec, b_doc, b_sec, similarity (rounded to four places); ties in
    the order of (a, b). Fewer than two documents give no pairs, and nothing is compared. ``trace``
    gets (least df, largest df, bound, pairs compared) of each block."""
    spark = rows.sparkSession
    place = F.struct(F.col("doc_index").cast("long").alias("doc"), F.col("section_index").cast("long").alias("sec"))
    base = rows.select(place.alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    own = base.select(class_of("text").alias("class"), "at")
    # The first members of a class that can stand in one of the best pairs.
    per_doc = own.groupBy("class", F.col("at.doc").alias("doc")).agg(F.min("at").alias("least"))
    heads = per_doc.groupBy("class").agg(F.min_by("least", "doc").alias("one"), F.min("doc").alias("d1"))
    # The least member in another document than the class's least one.
    other = per_doc.join(heads.select("class", "d1"), "class").where("doc <> d1").groupBy("class").agg(F.min("least").alias("two"))
    heads = written(heads.join(other, "class", "left"), new_path(spark, "class-heads"))
    best_schema = "x binary, y binary, similarity double, a struct<doc:bigint,sec:bigint>, b struct<doc:bigint,sec:bigint>"
    found: list = []
    one = heads.agg(F.min("d1").alias("d1"), F.max("d1").alias("d2"), F.count("two").alias("copies")).first()
    if one["copies"] or one["d1"] != one["d2"]:
        classes = _classes(base, stop)
        numbered = written(heads.join(classes.select("id", "class"), "class").drop("class").withColumnRenamed("id", "class"), new_path(spark, "numbered-heads"))
        found = _rising(spark, _postings(classes), numbered, threshold, most, [] if trace is None else trace)
    if found:
        # Back from numbers to the texts' own keys, of at most 2 * ``most`` classes.
        few = sorted({c for r in found for c in (r["x"], r["y"])})
        keys = {r["id"]: bytes(r["class"]) for r in classes.where(F.col("id").isin(few)).select("id", "class").collect()}
        found = [(keys[r["x"]], keys[r["y"]], r["similarity"], r["a"], r["b"]) for r in found]
    best = spark.createDataFrame(found, best_schema)
    # Members of the few classes left: at most ``most`` + 1 places of at most ``most`` + 1 documents.
    few = own.join(F.broadcast(best.select(F.explode(F.array("x", "y")).alias("class")).distinct()), "class")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("class", "at.doc").orderBy("at"))).where(F.col("k") <= most + 1)
    few = few.withColumn("d", F.dense_rank().over(Window.partitionBy("class").orderBy("at.doc"))).where(F.col("d") <= most + 1)
    member = lambda k, c: few.select(F.col("class").alias(k), F.col("at").alias(c))
    every = best.select("x", "y", "similarity").join(member("x", "m"), "x").join(member("y", "o"), "y").where("m.doc <> o.doc")
    every = every.select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"), "similarity").distinct()
    top = every.orderBy(F.desc("similarity"), "a", "b").limit(most)
    pair = F.format_string("%d:%d__%d:%d", "a.doc", "a.sec", "b.doc", "b.sec")
    return top.select(pair.alias("pair_id"), F.col("a.doc").alias("a_doc"), F.col("a.sec").alias("a_sec"), F.col("b.doc").alias("b_doc"), F.col("b.sec").alias("b_sec"), "similarity")


def shared_words(a: Column, b: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.array_sort(F.array_intersect(F.array_distinct(significant_words(a, stop)), significant_words(b, stop)))
