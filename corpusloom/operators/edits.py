"""Edits of documents: literal replacement and deletion of sections, ordered edits, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse_blank_lines, first_h1, rtrim
from ..sources.shared import new_path, written


def occurs(markdown: Column, part: Column) -> Column:
    """Whether a section still stands in its document."""
    return (part != "") & F.contains(markdown, part)


def replace_first(markdown: Column, old: Column, new: Column) -> Column:
    """The first literal occurrence of old replaced; unchanged if it is absent or empty."""
    at = F.position(old, markdown)
    return F.when(occurs(markdown, old), F.concat(F.substr(markdown, F.lit(1), at - 1), new, F.substr(markdown, at + F.length(old)))).otherwise(markdown)


def delete_section(markdown: Column, part: Column) -> Column:
    """The document without a section, blank lines collapsed, one newline at the end."""
    gone = F.concat(rtrim(collapse_blank_lines(replace_first(markdown, part, F.lit("")))), F.lit("\n"))
    return F.when(occurs(markdown, part), gone).otherwise(markdown)


def admissible(edits: DataFrame) -> DataFrame:
    """edits: (original_order, a_doc, a_sec, b_doc, b_sec). Adds accepted: an edit of two sections
    holds if no earlier edit claims either of them; the effect of running edits one after the
    other, each seeing those before. A pair list is capped where it is made, so it is small."""
    claims = edits.select("original_order", F.explode(F.array(F.struct(F.col("a_doc").alias("d"), F.col("a_sec").alias("s")), F.struct(F.col("b_doc").alias("d"), F.col("b_sec").alias("s")))).alias("c"))
    first = claims.groupBy("c").agg(F.min("original_order").alias("first"))
    ok = claims.join(first, "c").groupBy("original_order").agg(F.bool_and(F.col("original_order") == F.col("first")).alias("accepted"))
    return edits.join(ok, "original_order")


def rewrite_pairs(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs: (doc_index, markdown); edits: (original_order, a_doc, a_text, new_a, b_doc, b_text,
    new_b). Both sides or none: adds ok and the new texts of each document that an edit changes.
    Edits of one document must be accepted ones of different sections."""
    a, b = docs.select(F.col("doc_index").alias("a_doc"), F.col("markdown").alias("a_md")), docs.select(F.col("doc_index").alias("b_doc"), F.col("markdown").alias("b_md"))
    e = edits.join(a, "a_doc").join(b, "b_doc")
    ok = occurs(F.col("a_md"), F.col("a_text")) & occurs(F.col("b_md"), F.col("b_text"))
    return e.withColumn("ok", ok).select("original_order", "ok", "a_doc", "b_doc", F.when(F.col("ok"), replace_first(F.col("a_md"), F.col("a_text"), F.col("new_a"))).otherwise(F.col("a_md")).alias("a_new"), F.when(F.col("ok"), replace_first(F.col("b_md"), F.col("b_text"), F.col("new_b"))).otherwise(F.col("b_md")).alias("b_new"))


def versions(history: DataFrame) -> DataFrame:
    """history: (doc_index, version, markdown). The newest version of each document."""
    return history.groupBy("doc_index").agg(F.max(F.struct("version", "markdown")).alias("v")).select("doc_index", "v.version", "v.markdown")


def undo(history: DataFrame, doc_index: int, part: Column, before: Column) -> DataFrame:
    """A new version of one document with an edit's section put back; later edits of other
    sections stay."""
    now = versions(history).where(F.col("doc_index") == doc_index)
    back = now.select("doc_index", (F.col("version") + 1).alias("version"), replace_first(F.col("markdown"), part, before).alias("markdown"))
    return history.unionByName(back)


def commit(docs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_index, markdown); edits as in ``rewrite_pairs``, with a_sec and b_sec. All edits in
    their order, each both sides or none. (history, report): history holds version 0 of every
    document and version 1 of those that an edit changed; report adds ``state`` to every edit: done,
    stale (a section no longer stands in its document) or claimed (by an earlier edit)."""
    # Written, as the claims read the edits three times.
    named = admissible(written(edits, new_path(edits.sparkSession, "edits")))
    a, b = docs.select(F.col("doc_index").alias("a_doc"), F.col("markdown").alias("a_md")), docs.select(F.col("doc_index").alias("b_doc"), F.col("markdown").alias("b_md"))
    found = named.join(a, "a_doc", "left").join(b, "b_doc", "left")
    both = F.coalesce(occurs(F.col("a_md"), F.col("a_text")) & occurs(F.col("b_md"), F.col("b_text")), F.lit(False))
    report = found.withColumn("state", F.when(~F.col("accepted"), "claimed").when(both, "done").otherwise("stale")).drop("a_md", "b_md", "accepted")
    return _next_version(docs.select("doc_index", F.lit(0).alias("version"), "markdown"), report.where("state = 'done'"), back=False), report


def _next_version(history: DataFrame, edits: DataFrame, back: bool) -> DataFrame:
    """history and one more version of each document with an edit; ``back`` puts the old sections in."""
    side = lambda c: F.struct("original_order", F.col(f"{c}_doc").alias("doc_index"), F.col(f"new_{c}" if back else f"{c}_text").alias("old"), F.col(f"{c}_text" if back else f"new_{c}").alias("new"))
    # A section is edited once, so a document has no more edits than sections.
    each = edits.select(F.explode(F.array(side("a"), side("b"))).alias("e")).groupBy("e.doc_index").agg(F.sort_array(F.collect_list("e"), asc=not back).alias("es"))
    new = versions(history).join(each, "doc_index").select("doc_index", (F.col("version") + 1).alias("version"), F.aggregate("es", F.col("markdown"), lambda md, e: replace_first(md, e["old"], e["new"])).alias("markdown"))
    return history.unionByName(new)


def revert(history: DataFrame, edits: DataFrame) -> DataFrame:
    """Undo of done edits: one more version of their documents with the old sections put back; other
    edits of the same documents stay. The pairs come back to the list by original_order."""
    return _next_version(history, edits, back=True)


def report_deletions(pairs: DataFrame, side: Column) -> DataFrame:
    """pairs with a_text and b_text; side is 'a' or 'b'. Headings of the deleted and the kept section."""
    a, b = first_h1(F.col("a_text")), first_h1(F.col("b_text"))
    return pairs.withColumn("deleted_side", side).withColumn("deleted_heading", F.when(side == "a", a).otherwise(b)).withColumn("kept_heading", F.when(side == "a", b).otherwise(a))


def batches(pairs: DataFrame, order: list, size: int = 8) -> DataFrame:
    """Adds original_order and batch_no to a capped list of pairs."""
    n = F.row_number().over(Window.orderBy(*order)) - 1
    return pairs.withColumn("original_order", n).withColumn("batch_no", F.floor(F.col("original_order") / size).cast("int"))
