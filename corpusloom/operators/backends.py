"""Stages that call a model: rendering, batching, calling through a backend, reading replies.

A backend is a function from a list of prompts to a list of replies; it runs in Arrow batches on
the executors. The default backends are deterministic stubs that say nothing about quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import clamp, first_h1, salvage_json, strip_orphan_fences

Backend = Callable[[list[str]], list[str]]
VERDICT = "array<struct<pair_id:string,verdict:string,similarity:string,shared_topic:string,reason:string,a_unique_angle:string,b_unique_angle:string,dominant:string>>"


class NotConfigured(RuntimeError):
    """No model is configured."""


def route_model(config: dict, pro: bool = False) -> str:
    """The model's name from a configuration; NotConfigured without a key."""
    if not config.get("key"):
        raise NotConfigured("no key")
    return config.get("pro_model" if pro else "model") or config["model"]


def call(rows: DataFrame, prompt: str, backend: Backend, out: str = "reply", retries: int = 1, parallel: int | None = None, counter: Observation | None = None) -> DataFrame:
    """Adds the replies; a batch that fails after its retries gives null replies. A row without a prompt
    isn't sent and has none. Other columns pass through Arrow as they are. ``counter`` gets ``called`` and ``failed``, the rows with a prompt and
    those of them without a reply, once an action has run."""
    rows = rows.repartition(parallel) if parallel else rows
    wanted = rows.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(prompt)
            sent = asked.drop_null().to_pylist()
            answers: list[str | None] = [None] * len(sent)
            for _ in range(retries + 1 if sent else 0):
                try:
                    answers = backend(sent)
                    break
                except Exception:  # noqa: BLE001  a model's failure costs its batch only
                    continue
            if len(answers) != len(sent):
                raise ValueError(f"{len(answers)} replies to {len(sent)} prompts")
            left = iter(answers)
            replies = [next(left) if has else None for has in asked.is_valid().to_pylist()]
            kept = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(replies, pa.string())], [*kept, out])

    found = rows.mapInArrow(run, wanted)
    if counter is None:
        return found
    asked = F.col(prompt).isNotNull()
    return found.observe(counter, F.count_if(asked).alias("called"), F.count_if(asked & F.col(out).isNull()).alias("failed"))


def stub_verdict(cosine: Column) -> Column:
    return F.when(cosine >= 0.9, "duplicate").when(cosine >= 0.5, "overlap").otherwise("distinct")


def render_pair(pair_id: Column, a_doc: Column, a_text: Column, b_doc: Column, b_text: Column, cosine: Column) -> Column:
    """One pair of a judge's prompt; texts are clamped."""
    head = lambda x: first_h1(x)
    return F.concat(F.lit("### "), pair_id, F.lit("\ncosine: "), cosine.cast("string"), F.lit("\nA ("), a_doc, F.lit(", "), head(a_text), F.lit("):\n"), clamp(a_text), F.lit("\nB ("), b_doc, F.lit(", "), head(b_text), F.lit("):\n"), clamp(b_text))


def render_batches(rows: DataFrame, batch: str = "batch_no", order: str = "original_order", text: str = "rendered") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(batch).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("prompt"), F.count(F.lit(1)).alias("pairs"))


def fix_lines(fixes: Column) -> Column:
    """The numbered list of a document's array of fixes, by ord."""
    line = lambda z: F.concat_ws(" ", F.concat(F.lit("["), z["type"], F.lit("]")), z["location"], F.concat(F.lit("("), z["current_tokens"].cast("string"), F.lit(" tokens):")), z["message"])
    parts = F.sort_array(F.transform(fixes, lambda z: F.struct(z["ord"].alias("ord"), line(z).alias("l"))))
    return F.array_join(F.transform(parts, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["l"])), "\n")


def render_fixes(fixes: DataFrame, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """The numbered list of fixes of each document."""
    return fixes.groupBy(*keys).agg(fix_lines(F.collect_list(F.struct("ord", "type", "location", "current_tokens", "message"))).alias("fix_list"))


def read_verdicts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Verdicts of judge replies: of a known label and with a pair_id; similarity within 0 and 1 (a
    value that is no JSON number counts as 0); an unknown dominant side is 'neither'."""
    # Strings in the reply keep their quotes in the raw text, numbers have none.
    raw = replies.select(F.explode(salvage_json(F.col(reply), "array<string>")).alias("o"))
    v = raw.select("o", F.from_json("o", VERDICT[6:-1]).alias("v")).where(F.col("v.pair_id").isNotNull() & F.col("v.verdict").isin("duplicate", "overlap", "distinct"))
    number = F.when(F.col("o").rlike(r'"similarity"\s*:\s*-?[0-9.]'), F.col("v.similarity").try_cast("double"))
    text = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(""))
    return v.select(
        F.col("v.pair_id").alias("pair_id"),
        F.col("v.verdict").alias("verdict"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))).alias("similarity"),
        text("shared_topic").alias("shared_topic"),
        text("reason").alias("reason"),
        text("a_unique_angle").alias("a_unique_angle"),
        text("b_unique_angle").alias("b_unique_angle"),
        F.when(F.col("v.dominant").isin("a", "b"), F.col("v.dominant")).otherwise("neither").alias("dominant"),
    )


def enrich_verdicts(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Duplicates and overlaps with their candidate; deletion is offered if a side dominates."""
    kept = verdicts.where(F.col("verdict").isin("duplicate", "overlap")).join(candidates, "pair_id")
    return kept.withColumn("offer_delete", F.col("dominant").isin("a", "b"))


def verdict_lists(enriched: DataFrame) -> DataFrame:
    """(verdict, pairs): the list of duplicates and that of overlaps, by original_order. Pairs are
    capped where they are made, so a list is small."""
    ordered = F.sort_array(F.collect_list(F.struct("original_order", "pair_id")))
    return enriched.groupBy("verdict").agg(F.transform(ordered, lambda x: x["pair_id"]).alias("pairs"))


def read_rewrite(reply: Column) -> Column:
    """The two sections of a rewrite reply, trimmed; null unless both are texts."""
    r = salvage_json(reply, "struct<section_a:string,section_b:string>")
    return F.when(r["section_a"].isNotNull() & r["section_b"].isNotNull(), F.struct(F.trim(r["section_a"]).alias("section_a"), F.trim(r["section_b"]).alias("section_b")))


def read_questions(reply: Column) -> Column:
    """The non-blank strings of a question reply."""
    return F.filter(F.coalesce(salvage_json(reply, "array<string>"), F.array().cast("array<string>")), lambda q: F.trim(q) != "")


def standardize_text(department: Column, topic: Column, course_id: Column, course_name: Column, raw: Column) -> Column:
    """The text that asks for a standard document, whether or not fields are empty; null if one is null."""
    return F.concat(F.lit("Rewrite the notes below as a knowledge document with frontmatter.\nDepartment: "), department, F.lit("\nTopic: "), topic, F.lit("\nCourse: "), course_id, F.lit(" "), course_name, F.lit("\n\n"), raw)


def standardize_prompt(department: Column, topic: Column, course_id: Column, course_name: Column, raw: Column) -> Column:
    """Prompt that asks for a standard document; null if one of the fields is missing."""
    missing = F.lit(False)
    for c in (department, topic, course_id, course_name, raw):
        missing = missing | (F.coalesce(c, F.lit("")) == "")
    return F.when(~missing, standardize_text(department, topic, course_id, course_name, raw))


def standardized(reply: Column) -> Column:
    return strip_orphan_fences(reply)
