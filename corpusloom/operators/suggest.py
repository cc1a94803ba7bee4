"""Keyword suggestions for chunks, and putting a term into a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import ALIASES, HOOKS, METRICS, ROLES, SUGGESTED_ROLES
from ..functions.text import has_term, trim

# Fixed value: words of a chunk of steps.
STEPS = r"(?iu)(?:steps?|langkah|prosedur|how to|cara)(?![A-Za-z0-9_])"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def alias_bucket(topic: Column, aliases=ALIASES) -> Column:
    """The first dictionary entry whose key is in the topic, or an alias of which is the topic:
    key and aliases. Null if there is none."""
    low = F.lower(trim(F.coalesce(topic, F.lit(""))))
    hit = F.lit(None).cast("array<string>")
    for key, names in reversed(aliases):
        hit = F.when(F.contains(low, F.lit(key.lower())) | low.isin([n.lower() for n in names]), _strings([key, *names])).otherwise(hit)
    return hit


def _missing(text: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: ~has_term(text, t))


def _suggestion(ord_: int, category: str, severity: str, terms: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), terms.alias("suggested_terms"))


def suggest(chunks: DataFrame, text: str = "text", topic: str | None = "topic", role_tags: bool = True, aliases=ALIASES, keys: tuple[str, ...] = ("doc_index", "chunk_index")) -> DataFrame:
    """keys, ord, category, severity, suggested_terms. One row of chunks is handled alone: no
    join, no shuffle; the dictionaries are literals of the plan."""
    t, none = F.col(text), F.lit(None).cast("array<string>")
    bucket = alias_bucket(F.col(topic), aliases) if topic else none
    alias = F.slice(_missing(t, F.coalesce(bucket, _strings([]))), 1, 1)
    hook = none
    for trigger, names in reversed(HOOKS):
        hook = F.when(has_term(t, F.lit(trigger)), F.slice(_missing(t, _strings(names)), 1, 3)).otherwise(hook)
    role = F.when(F.lit(role_tags) & t.rlike(STEPS) & ~F.exists(_strings(ROLES), lambda r: has_term(t, r)), _strings(SUGGESTED_ROLES))
    metric = none
    for pattern, names in reversed(METRICS):
        metric = F.when(t.rlike(pattern), F.when(F.size(_missing(t, _strings(names))) == len(names), F.slice(_strings(names), 1, 2)).otherwise(none)).otherwise(metric)
    made = F.array(_suggestion(0, "entity_alias", "warn", alias), _suggestion(1, "question_hook", "info", hook), _suggestion(2, "role_tag", "info", role), _suggestion(3, "metric_label", "info", metric))
    made = F.filter(made, lambda s: F.coalesce(F.size(s["suggested_terms"]), F.lit(0)) > 0)
    return chunks.select(*keys, F.inline(made))


def insert_term(text: Column, term: Column) -> Column:
    """The text with the term put in: after a short title, as a sentence after a long one, or as a
    sentence in front."""
    head = F.get(F.split(text, "\n"), 0)
    rest = F.substr(text, F.length(head) + 1)
    # The two sentences.
    known, relates = (F.concat(F.lit(x), term, F.lit("**.")) for x in ("This section is also known by the term **", "This section relates to **"))
    with_head = F.when((F.length(head) < 80) & ~F.contains(head, F.lit("(")), F.concat(head, F.lit(" ("), term, F.lit(")"), rest)).otherwise(F.concat(head, F.lit("\n\n"), known, rest))
    return F.when((term == "") | has_term(text, term), text).when(head.startswith("# "), with_head).otherwise(F.concat(relates, F.lit("\n\n"), text))


def apply(docs: DataFrame, markdown: str, chunk: str, term: str) -> DataFrame:
    """Adds updated and applied: the chunk's first literal occurrence in the document replaced by
    the chunk with the term; applied tells the truth if the chunk is not there."""
    # What stands before the chunk is found once a row and by bytes: positions in characters would be counted
    # from the start of the document each time.
    placed = docs.withColumn("_new", insert_term(F.col(chunk), F.col(term)))
    head = F.call_function("substring_index", F.col(markdown), F.col(chunk), F.lit(1))
    placed = placed.withColumn("_head", F.when((F.col("_new") != F.col(chunk)) & (F.col(chunk) != ""), head))
    # Without an occurrence that is the whole document.
    done = F.coalesce(F.octet_length("_head") < F.octet_length(markdown), F.lit(False))
    rest = F.substr(F.col(markdown).cast("binary"), F.octet_length("_head") + F.octet_length(chunk) + 1).cast("string")
    updated = F.concat(F.col("_head"), F.col("_new"), rest)
    return placed.withColumn("updated", F.when(done, updated).otherwise(F.col(markdown))).withColumn("applied", done).drop("_new", "_head")
