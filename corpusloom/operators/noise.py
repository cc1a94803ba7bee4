"""Slide noise: closing and cover slides, and footer lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import NoiseConfig
from ..functions.text import blocks, collapse_blank_lines, is_blank, once, text_or_empty, trim

# Labels of dropped slides.
FIRST, LAST = "first (title-only)", "last (thank-you / Q&A / closing)"


def slides(markdown: Column) -> Column:
    """Trimmed blocks from H1 to H1; text before the first is a slide of its own."""
    return F.when(is_blank(text_or_empty(markdown)), F.array().cast("array<string>")).otherwise(blocks(markdown, r"#\s+"))


def title_only(slide: Column) -> Column:
    lines = F.filter(F.transform(F.split(slide, "\n"), trim), lambda x: x != "")
    return once(lines, lambda ls: (F.size(ls) > 0) & F.get(ls, F.lit(0)).startswith("#") & ((F.size(ls) == 1) | ((F.size(ls) == 2) & (F.length(F.get(ls, F.lit(1))) < 80))))


def closing(slide: Column, phrases: tuple[str, ...]) -> Column:
    # No more of the slide is split and lower-cased than is looked at.
    head = F.lower(F.array_join(F.slice(F.filter(F.split(trim(slide), r"\s+", 9), lambda x: x != ""), 1, 8), " "))
    return once(head, lambda h: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(h, p)))


def is_noise(line: Column, config: NoiseConfig) -> Column:
    return trim(line).rlike(rf"\A(?:{'|'.join(config.patterns)})\z")


def filter_noise(docs: DataFrame, markdown: str = "markdown", config: NoiseConfig = NoiseConfig()) -> DataFrame:
    """Adds cleaned, original_slides, kept_slides, dropped_slides and noise_lines_stripped."""
    none = F.array().cast("array<string>")
    out = docs.withColumn("_s", slides(F.col(markdown)))
    out = out.withColumn("_first", (F.size("_s") > 0) & title_only(F.get("_s", F.lit(0))) if config.drop_title_only else F.lit(False))
    out = out.withColumn("_t", F.when(F.col("_first"), F.filter("_s", lambda x, k: k > 0)).otherwise(F.col("_s")))
    out = out.withColumn("_last", (F.size("_t") > 0) & closing(F.get("_t", F.size("_t") - 1), config.closing))
    out = out.withColumn("_t", F.when(F.col("_last"), F.filter("_t", lambda x, k: k < F.size("_t") - 1)).otherwise(F.col("_t")))
    lines = F.transform("_t", lambda s: F.split(s, "\n"))
    out = out.withColumn("_n", F.aggregate(lines, F.lit(0), lambda a, ls: a + F.size(F.filter(ls, lambda x: is_noise(x, config) & (trim(x) != "")))))
    kept = F.transform("_t", lambda s: trim(F.array_join(F.filter(F.split(s, "\n"), lambda x: ~is_noise(x, config)), "\n")))
    out = out.withColumn("_k", F.filter(kept, lambda s: s != ""))
    dropped = F.concat(F.when(F.col("_first"), F.array(F.lit(FIRST))).otherwise(none), F.when(F.col("_last"), F.array(F.lit(LAST))).otherwise(none))
    return out.select(
        *docs.columns,
        collapse_blank_lines(F.array_join("_k", "\n\n")).alias("cleaned"),
        F.size("_s").alias("original_slides"),
        F.size("_k").alias("kept_slides"),
        dropped.alias("dropped_slides"),
        F.col("_n").alias("noise_lines_stripped"),
    )
