"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words, A-Z as a-z. Lines whose Jaccard similarity is at least
``SIMILARITY`` match; the join (see ``setjoin``) orders words by rarity and applies the prefix, the
positional and the length filter before it verifies the sets. A line that matches any earlier line,
by (doc_id, hash of the text, line number), is removed.

For classes all matches count: lines linked over matches are a class, and documents that hold lines
of one class are linked in turn.

Defined cases: null and wordless texts have no lines to match; rows without a doc_id are kept as
they are; rows with equal doc_id and text are one document, whose lines do not match themselves, so
they keep the same lines; rows that repeat a doc_id with another text are different documents; texts
may have any number of lines of any length; an empty table gives no rows. Neither partitions nor
batches change a result.
"""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import Scratch, among, counted, has_word, materialize, table
from .components import connected_components
from .tokens import lines

SIMILARITY = 0.8
PLACE = ["doc_id", "text_key", "line"]


def _removed(found: setjoin.Found, links: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, first_doc, first_line) of each line that matches an earlier one."""
    scratch, heads = found.scratch, found.heads
    matched = scratch.write(links.groupBy(F.col("later").alias("nid")).agg(F.min("earlier").alias("first")), "first-matches")
    some = heads.select("nid", "node", "copies", *[F.col(c).alias(f"head_{c}") for c in PLACE]).join(matched, "nid", "left").where("copies > 1 or first is not null")
    named = heads.select(F.col("nid").alias("first"), F.col("doc_id").alias("at_doc"), F.col("line").alias("at_line"))
    named = named.join(counted(scratch.write(matched.select("first").distinct(), "first-nodes")), "first", "left_semi")
    some = some.join(named, "first", "left").select("node", *[f"head_{c}" for c in PLACE], F.col("first").isNotNull().alias("matched"), F.coalesce("at_doc", "head_doc_id").alias("first_doc"), F.coalesce("at_line", "head_line").alias("first_line"))
    some = scratch.write(some, "matched-nodes")
    own = (F.col("doc_id") == F.col("head_doc_id")) & (F.col("text_key") == F.col("head_text_key")) & (F.col("line") == F.col("head_line"))
    return found.places.join(counted(some), "node").where(~own | F.col("matched")).select(*PLACE, "first_doc", "first_line")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, line, first_doc, first_line) for each line that matches an earlier one;
    the first of its confirmed matches."""
    found = setjoin.find(docs, lines, similarity, id_col, text)
    out = materialize(_removed(found, setjoin.joined(found, earlier=True, connect=False)), "removed-lines")
    found.scratch.drop()
    return out


def _by_document(removed: DataFrame) -> DataFrame:
    return removed.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_set("line").alias("gone_lines"))


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone):
        if t is None or g is None:
            out.append(None)
            continue
        drop = set(g.tolist())
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
    return pd.Series(out, dtype=object)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: str | None = "n_chars") -> DataFrame:
    """docs without the lines that match earlier ones, all its columns kept; column ``size`` (if
    docs has it) becomes the new number of characters. No row is dropped."""
    gone = materialize(_by_document(removed_lines(docs, id_col, text, similarity)), "gone-lines")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"))
    # Whole texts are shuffled only if they lose lines.
    row = row.withColumn("loses", among(gone.select(F.xxhash64("gone_id", "gone_key").alias("key")))(F.xxhash64("own_id", "own_key")))
    body = F.col(f"row.`{text}`")

    def given(rows: DataFrame, new: Column) -> DataFrame:
        out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: new}
        if size in docs.columns:
            out[size] = F.length(new).cast(docs.schema[size].dataType)
        return rows.select(*[v.alias(k) for k, v in out.items()])

    met = row.where("loses").join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left")
    met = met.withColumn("left_text", F.pandas_udf(_without, "string")(F.when(F.col("gone_lines").isNotNull(), body), "gone_lines"))
    return given(row.where(~F.col("loses")), body).unionByName(given(met, F.when(F.col("gone_lines").isNull(), body).otherwise(F.col("left_text"))))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each (doc_id, text): doc_id, text_key, n_links, n_matches, class_id, removed_lines. n_links:
    other lines in the classes of its lines; n_matches: of these, those that match the line itself, for
    each of its lines, so every pair of lines that match counts once at each end; class_id: the smallest doc_id reachable over lines of
    one class; removed_lines: the numbers of its lines that match earlier ones. Documents none of
    whose lines is linked are absent."""
    found = setjoin.find(docs, lines, similarity, id_col, text)
    scratch, keep = found.scratch, Scratch(docs.sparkSession)
    links = setjoin.joined(found, earlier=True, connect=True)
    # Nodes of classes of two lines or more, with the class and its number of lines.
    some = found.heads.select("nid", "node", "copies", *PLACE).join(setjoin.roots(scratch, links), "nid", "left")
    some = scratch.write(some.where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "nid")), "class-nodes")
    # No other line has a match, so all heads and places are looked through once.
    places = scratch.write(found.places.join(counted(some.select("node")), "node", "left_semi"), "class-places")
    removed = scratch.write(_by_document(_removed(replace(found, heads=some, places=places), links)), "gone-lines")
    whole = scratch.write(some.groupBy("root").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("nodes"), F.min("doc_id").alias("root_doc")), "class-sizes")
    some = scratch.write(some.drop(*PLACE).join(counted(whole), "root").select("nid", "root", "nodes", "copies", "node", (F.col("n") - 1).alias("others"), "root_doc"), "class-of-node")
    # All lines of a class of one or two nodes match; of more nodes, those that are compared.
    compared = setjoin.matched(found, some.where("nodes > 2")).withColumn("matches", F.col("matches") + F.col("copies") - 1)
    some = some.where("nodes <= 2").select("node", "others", "root_doc", F.col("others").alias("matches")).unionByName(compared.select("node", "others", "root_doc", "matches"))
    some = scratch.write(some, "matches-of-node")
    members = places.join(counted(some), "node")
    held = members.groupBy("doc_id", "text_key", "root_doc").agg(F.sum("others").alias("others"), F.sum("matches").alias("matches"))
    held = scratch.write(held, "documents-of-classes")
    cc = scratch.write(connected_components(held.select("doc_id", "root_doc").distinct(), "doc_id", "root_doc"), "document-classes")
    out = held.groupBy("doc_id", "text_key").agg(F.sum("others").alias("n_links"), F.sum("matches").alias("n_matches"))
    out = out.join(cc.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("class_id", F.coalesce("root", "doc_id"))
    out = out.join(removed, (F.col("doc_id") == F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    out = keep.write(out.select("doc_id", "text_key", "n_links", "n_matches", "class_id", F.sort_array(F.coalesce("gone_lines", F.array().cast("array<int>"))).alias("removed_lines")), "line-classes")
    scratch.drop()
    return out


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: n_lines (lines with a word), n_links, n_matches, class_id and removed_lines of ``classes``;
    a document without links is a class of its own."""
    docs = table(spark, sf_dir, "documents")
    number = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: has_word(x)))
    found = classes(docs).select(F.col("doc_id").alias("at"), "text_key", "n_links", "n_matches", "class_id", F.array_join("removed_lines", ",").alias("removed_lines"))
    out = docs.select("doc_id", F.xxhash64("text").alias("key"), number.cast("long").alias("n_lines")).join(found, (F.col("doc_id") == F.col("at")) & (F.col("key") == F.col("text_key")), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))
