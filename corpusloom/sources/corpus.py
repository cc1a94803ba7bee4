"""Markdown corpora: scans, gates, upserts, adapters, sinks, and the composed test corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import object_key, trim

NL = "chr(10)"

#: One section of markdown for each row of documents; the same text runs in both SQL engines.
SECTION = f"""concat(
  CASE WHEN doc_id % 11 = 0 THEN '#  Topic ' ELSE '# Topic ' END, CAST(doc_id AS STRING), {NL}, {NL},
  CASE WHEN doc_id % 3 = 0 THEN replace(text, {NL}, concat({NL}, {NL})) ELSE text END,
  CASE WHEN doc_id % 3 = 1 THEN concat({NL}, {NL}, 'Acme owns this item.') ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat({NL}, {NL}, '## Detail', {NL}, {NL}, 'Short note on the policy and procedure.') ELSE '' END,
  CASE WHEN doc_id % 4 = 0 THEN concat({NL}, {NL}, '**Steps to follow:**', {NL}, {NL}, '- alpha 10%', {NL}, '- beta') ELSE '' END,
  CASE WHEN doc_id % 4 = 1 THEN concat({NL}, {NL}, 'No lead-in here.', {NL}, '1. one', {NL}, '2. two') ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat({NL}, {NL}, 'Page ', CAST(doc_id % 9 AS STRING), ' of 9') ELSE '' END)"""

#: The document around its sections: frontmatter of several kinds, cover and closing slides.
WRAPPED = f"""concat(
  CASE WHEN di % 5 = 0 THEN ''
    WHEN di % 5 = 1 THEN concat('---', {NL}, 'department: "Global"', {NL}, 'course_id: ', CAST(di AS STRING), {NL}, 'course_name: "Course ', CAST(di AS STRING), '"', {NL}, '---', {NL}, {NL})
    WHEN di % 5 = 3 THEN concat('---', {NL}, 'department: "Global"', {NL}, 'topic: "policy---rules"', {NL}, 'course_id: 0', {NL}, 'course_name: "Course ', CAST(di AS STRING), '"', {NL}, '---', {NL}, {NL})
    ELSE concat('---', {NL}, 'department: "Global"', {NL}, 'topic: "Procedure ', CAST(di AS STRING), '"', {NL}, 'course_id: ', CAST(di AS STRING), {NL}, 'course_name: "Course ', CAST(di AS STRING), '"', {NL}, '---', {NL}, {NL}) END,
  CASE WHEN di % 2 = 0 THEN concat('# Cover', {NL}, {NL}, 'Spring deck', {NL}, {NL}) ELSE '' END,
  secs,
  CASE WHEN di % 2 = 0 THEN concat({NL}, {NL}, '# Thank you!') ELSE '' END,
  CASE WHEN di % 5 = 4 THEN concat({NL}, {NL}, '---', {NL}, {NL}, 'Contact us.') ELSE '' END, {NL})"""

#: Sections of one composed document: consecutive ids, so no document grows with the table.
SECTIONS_EACH = 50


def md_docs_sql(listing: str) -> str:
    """listing: how the engine spells the ordered concatenation of sec, with {NL}{NL} between."""
    return f"""SELECT di AS doc_index, concat('doc', CAST(di AS STRING), '.md') AS doc_name, {WRAPPED} AS markdown
FROM (SELECT CAST(floor(doc_id / {SECTIONS_EACH}) AS BIGINT) AS di, {listing} AS secs
  FROM (SELECT doc_id, {SECTION} AS sec FROM documents) s GROUP BY CAST(floor(doc_id / {SECTIONS_EACH}) AS BIGINT)) d"""


def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_index, doc_name, markdown) from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spark.sql(md_docs_sql(f"listagg(sec, concat({NL}, {NL})) WITHIN GROUP (ORDER BY doc_id)").replace("FROM documents", "FROM {documents}"), documents=docs)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, markdown) of every .md or .markdown file below path, whole texts."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("doc_name"), F.col("value").alias("markdown"))
    return rows.where(is_markdown(F.col("doc_name")))


def skipped(names: DataFrame, name: str = "name") -> DataFrame:
    """One row: files kept, files skipped, and whether nothing is left to load."""
    kept = F.count_if(is_markdown(F.col(name)))
    return names.agg(kept.alias("kept"), F.count_if(~is_markdown(F.col(name))).alias("skipped"), (kept == 0).alias("nothing"))


def is_markdown(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(md|markdown)\z")


def upload_gate(name: Column) -> Column:
    """What becomes of an uploaded file's name at the client."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.(pdf|pptx)\z"), "parse").when(low.rlike(r"\.xlsx\z"), "spreadsheet").when(low.rlike(r"\.ppt\z"), "legacy").otherwise("refused")


def server_accepts(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(pptx?|pdf)\z")


def upload_key(stamp: Column, salt: Column, name: Column) -> Column:
    """Object key of an upload: time in base 36, a random part, a safe name."""
    return F.concat(F.lit("uploads/"), F.lower(F.conv(stamp.cast("string"), 10, 36)), F.lit("-"), salt, F.lit("-"), object_key(name))


def upsert(loaded: DataFrame, uploads: DataFrame) -> DataFrame:
    """loaded and uploads: (ord, name, markdown). Same names are replaced in place, others are
    appended; of one name the last upload wins. (place_batch, place_ord) sorts the result."""
    both = loaded.select("ord", "name", "markdown", F.lit(0).alias("batch")).unionByName(uploads.select("ord", "name", "markdown", F.lit(1).alias("batch")))
    last = both.groupBy("name").agg(F.max(F.struct("batch", "ord", "markdown")).alias("last"), F.min(F.struct("batch", "ord")).alias("first"))
    return last.select(F.col("first.batch").alias("place_batch"), F.col("first.ord").alias("place_ord"), "name", F.col("last.markdown").alias("markdown"))


def html_to_markdown(html: Column) -> Column:
    """Headings, list items, paragraphs and breaks of a page as markdown; other tags go."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for n in (1, 2, 3):
        c = F.regexp_replace(c, rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ")
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</(?:h[1-6]|p|div|ul|ol|article|table)\s*>|<p\b[^>]*>", "\n\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</tr\s*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), "\n{3,}", "\n\n")), F.lit("\n"))


def clusters_to_markdown(rows: DataFrame, cluster: str, order: str, speaker: str, text: str) -> DataFrame:
    """Spreadsheet-like rows to one H1 for each cluster, its rows in order; (cluster, markdown,
    n_rows). The contract of a spreadsheet source, inferred from its callers. A cluster is one
    sheet stage or conversation and is assumed to fit a task."""
    line = F.concat(F.lit("**"), F.coalesce(F.col(speaker), F.lit("")), F.lit(":** "), trim(F.coalesce(F.col(text), F.lit(""))))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    out = rows.groupBy(F.col(cluster).alias("cluster")).agg(parts.alias("p"), F.count(F.lit(1)).alias("n_rows"))
    body = F.array_join(F.transform("p", lambda x: x["l"]), "\n\n")
    return out.select("cluster", F.concat(F.lit("# "), F.col("cluster").cast("string"), F.lit("\n\n"), body, F.lit("\n")).alias("markdown"), "n_rows")


def sheet_stats(rows: DataFrame, sheet: str, cluster: str, text: str) -> DataFrame:
    """One row for the whole source: original_sheets, kept_chunks (clusters with a text that is not
    blank), dropped_sheets (names of the sheets without any, sorted). Names of sheets are few."""
    used = rows.groupBy(F.col(sheet).alias("sheet"), F.col(cluster).alias("cluster")).agg(F.bool_or(trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("used"))
    per = used.groupBy("sheet").agg(F.count_if("used").alias("chunks"))
    return per.agg(F.count(F.lit(1)).alias("original_sheets"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("kept_chunks"), F.sort_array(F.collect_list(F.when(F.col("chunks") == 0, F.col("sheet").cast("string")))).alias("dropped_sheets"))


def parse_result(status: DataFrame) -> DataFrame:
    """status: (job_id, state, markdown, text). Rows of finished jobs with their markdown."""
    return status.where("state = 'SUCCESS'").select("job_id", F.coalesce("markdown", "text", F.lit("")).alias("markdown"))


def sink_name(course: Column) -> Column:
    """File name of a single document."""
    return F.concat(F.when(trim(F.coalesce(course, F.lit(""))) == "", F.lit("knowledge")).otherwise(course), F.lit(".md"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """Every document as a text file in a folder of its name."""
    docs.select("doc_name", F.col("markdown").alias("value")).write.partitionBy("doc_name").text(path)


def write_zips(docs: DataFrame, folder: str) -> DataFrame:
    """Zip archives of all documents, see ``archives``; (archive, files)."""
    from . import archives

    return archives.write(docs, folder)
