"""Frontmatter: parse, build, replace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import FIELDS
from .text import ltrim, text_or_empty, trim

#: A flat line: a key, then nothing, a quoted string, or a bare value.
FLAT = r"""\A[A-Za-z_]\w*:(?:[ \t]+(?:"[^"]*"|'[^']*'|[^"'\s\[{][^\n]*)?)?[ \t]*\z"""


def parse(df: DataFrame, markdown: str = "markdown", general: bool = True) -> DataFrame:
    """Adds fm_present, the four fields (null if absent) and body.

    The block ends at the next ``---`` wherever it stands, and is cut from the body. Flat YAML is
    read here; with ``general`` a YAML library reads, in Arrow batches, the blocks that are not flat:
    any mapping or list is data. A block that is neither gives no data.
    """
    md = text_or_empty(F.col(markdown))
    left = ltrim(md)
    close = F.locate("---", left, 4)
    has = left.startswith("---") & (close > 0)
    yaml = trim(F.expr("substring(_left, 4, _close - 4)"))
    out = df.withColumn("_left", left).withColumn("_close", close).withColumn("_has", has)
    out = out.withColumn("_yaml", F.when(F.col("_has"), yaml))
    lines = F.filter(F.split("_yaml", "\n"), lambda x: trim(x) != "")
    flat = F.col("_has") & (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(FLAT))
    out = out.withColumn("fm_present", F.coalesce(flat, F.lit(False)))
    for f in FIELDS:
        raw = trim(F.regexp_extract("_yaml", rf"(?m)^{f}:[ \t]*(.*)$", 1))
        value = F.when(raw.isin("", "~", "null"), None).otherwise(F.regexp_replace(raw, r"""\A(["'])(.*)\1\z""", "$2"))
        out = out.withColumn(f, F.when(F.col("fm_present") & F.col("_yaml").rlike(rf"(?m)^{f}:"), value))
    out = out.withColumn("body", F.when(F.col("_has"), ltrim(F.expr("substring(_left, _close + 3)"))).otherwise(md))
    if general:
        # Only rows whose block isn't flat, few if any, pass through Python.
        odd = F.col("_has") & ~F.col("fm_present")
        more = out.where(odd).withColumn("_more", yaml_fields(F.col("_yaml")))
        for f in FIELDS:
            more = more.withColumn(f, F.col("_more")[f])
        more = more.withColumn("fm_present", F.col("_more.present")).drop("_more")
        out = out.where(~odd).unionByName(more)
    return out.drop("_left", "_close", "_has", "_yaml")


def yaml_fields(block: Column) -> Column:
    """Whether a block of YAML is a mapping or a list, and its fields, every value as text."""

    def one(text: str | None) -> tuple:
        import yaml

        data = None
        if text:
            try:
                data = yaml.load(text, Loader=yaml.BaseLoader)
            except (yaml.YAMLError, ValueError):
                pass
        of = data if isinstance(data, dict) else {}
        # The loader gives '' for a value that is absent; such a field is missing either way.
        return (isinstance(data, dict | list), *[None if of.get(f) in (None, "~", "null") else str(of[f]) for f in FIELDS])

    def read(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(one, blocks)), columns=["present", *FIELDS])

    return F.pandas_udf(read, "present boolean, department string, topic string, course_id string, course_name string")(block)


def build(department: Column, topic: Column, course_id: Column, course_name: Column) -> Column:
    """The block of four lines; strings quoted, the id bare."""
    q = lambda name, c: F.concat(F.lit(f'{name}: "'), text_or_empty(c), F.lit('"\n'))
    return F.concat(F.lit("---\n"), q("department", department), q("topic", topic), F.lit("course_id: "), text_or_empty(course_id), F.lit("\n"), q("course_name", course_name), F.lit("---\n"))


def replace(markdown: Column, block: Column) -> Column:
    """markdown with its block (closed by ``---`` at a line's start) replaced, or put in front."""
    left = ltrim(text_or_empty(markdown))
    at = F.locate("\n---", left, 4)
    after = F.substr(left, at + 4)
    rest = ltrim(F.when(F.locate("\n", after) > 0, F.substr(after, F.locate("\n", after) + 1)).otherwise(F.lit("")))
    return F.concat(block, F.lit("\n"), F.when(left.startswith("---") & (at > 0), rest).otherwise(left))
