"""Rule checks on markdown documents, their summary, and the plan of fixes.

A document's issues are built, put in order and numbered in its own row, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frontmatter
from ..functions.config import FIELDS, MAX_TOKENS, MIN_TOKENS
from ..functions.text import blocks, is_blank, once, split_before, trim, units
from .backends import fix_lines

# List lines, telephone numbers and addresses as the checks know them.
BULLET = r"\A\s*(?:[-*+]\s+|\d+\.\s+)"
PHONE = r"\+?\d[\d\s\-()]{7,}"
EMAIL = r"[\w.%+\-]+@[\w.-]+\.\w+"
#: Between ASCII word boundaries; its first letter is looked for before they are.
CONTACT = r"(?i)c(?<![A-Za-z0-9_]c)ontact\s+(us|me)(?![A-Za-z0-9_])"
H2 = r"##\s+"
#: What is told of an issue.
ISSUE = ("check", "severity", "location", "message")


def sections(body: Column) -> Column:
    """Blocks from H1 to H1; text before the first is a section without a title."""
    return F.when(is_blank(body), F.array().cast("array<string>")).otherwise(blocks(body, r"#\s+"))


def title(section: Column) -> Column:
    return trim(F.regexp_extract(F.get(F.split(section, "\n"), 0), r"\A#\s+([^\r\n]+)\z", 1))


def bullets_without_lead(section: Column) -> Column:
    """Whether some run of list lines lacks a lead-in: within three lines before it the first
    that is not blank must be no heading or list line and end in a colon (markup aside)."""
    blank = lambda x: trim(x) == ""
    ends = lambda x: F.regexp_replace(trim(x), r"[*_`]+\z", "").endswith(":") & ~trim(x).startswith("#") & ~x.rlike(BULLET)

    def bad(lines, flags, k):
        # A negative index is out of range and gives null: nothing to lead in.
        at = [F.get(lines, k - i) for i in (1, 2, 3)]
        lead = F.when(at[0].isNotNull() & ~blank(at[0]), ends(at[0])).when(at[1].isNotNull() & ~blank(at[1]), ends(at[1])).when(at[2].isNotNull() & ~blank(at[2]), ends(at[2])).otherwise(F.lit(False))
        begins = F.get(flags, k) & ~F.coalesce(F.get(flags, k - 1), F.lit(False))
        return begins & ~lead

    # Only where a list line begins is there anything to look at.
    places = lambda flags: F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda k: F.get(flags, k))
    marked = lambda lines: once(F.transform(lines, lambda x: x.rlike(BULLET)), lambda flags: F.exists(places(flags), lambda k: bad(lines, flags, k)))
    return once(F.split(section, "\n"), marked)


def _issue(phase: int, section: Column, sub: Column, rule: int, check: str, severity: str, location: Column, message: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), section.cast("int").alias("section"), sub.cast("int").alias("sub"), F.lit(rule).alias("rule"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), location.alias("location"), message.alias("message"))


def _sized(d: DataFrame, counter: Callable[[Column], Column], keys: tuple[str, ...]) -> DataFrame:
    """d with sized: for each section s of ss its counts ts, first of all of it, then of what each H2 begins."""
    parts = lambda s: F.transform(split_before(s, H2), lambda x, j: F.when(j == 0, s).otherwise(x))
    if not hasattr(counter, "evalType"):
        return d.withColumn("sized", F.transform("ss", lambda s: F.struct(s.alias("s"), F.transform(parts(s), lambda x: counter(x)).alias("ts"))))
    # Spark takes no Python UDF in a lambda: the parts are rows, and their counts are joined, without texts.
    rows = d.select(*keys, F.posexplode("ss").alias("k", "s")).select(*keys, "k", F.posexplode(parts(F.col("s"))).alias("j", "x")).withColumn("t", counter(F.col("x")))
    listed = lambda at, of: F.transform(F.sort_array(F.collect_list(F.struct(at, of))), lambda z: z[of]).alias("ts")
    counts = rows.groupBy(*keys, "k").agg(listed("j", "t")).groupBy(*keys).agg(listed("k", "ts"))
    counts = counts.select("ts", *[F.col(c).alias(f"of_{c}") for c in keys])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys])
    ts = F.coalesce("ts", F.array().cast("array<array<int>>"))
    return d.join(counts, same, "left").select(*d.columns, F.zip_with("ss", ts, lambda s, t: F.struct(s.alias("s"), t.alias("ts"))).alias("sized"))


def issue_lists(docs: DataFrame, markdown: str = "markdown", entity: str = "", low: int = MIN_TOKENS, high: int = MAX_TOKENS, counter: Callable[[Column], Column] = units, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """keys, markdown, issues: an array of (check, severity, location, message) in the order of the checks.
    Every text is read in its own row: no join, no shuffle, unless the counter is a Python UDF."""
    d = _sized(frontmatter.parse(docs.select(*keys, F.col(markdown).alias("markdown"))).withColumn("ss", sections(F.col("body"))), counter, keys)
    zero, none = F.lit(0), F.array().cast("array<struct<phase:int,section:int,sub:int,rule:int,check:string,severity:string,location:string,message:string>>")
    when = lambda test, issue: F.when(test, F.array(issue)).otherwise(none)
    said = lambda a, n, b: F.concat(F.lit(a), n.cast("string"), F.lit(b))
    stray = F.regexp_count("markdown", F.lit(r"(?m)^---\s*$"))
    head = [
        when(~F.col("fm_present"), _issue(0, zero, zero, 0, "frontmatter", "error", F.lit("top"), F.lit("Frontmatter is missing or cannot be read."))),
        *[when(F.coalesce(F.col(f), F.lit("")) == "", _issue(1, zero, F.lit(k), 0, "frontmatter", "error", F.lit(f"frontmatter.{f}"), F.lit(f"Required field {f} is missing or empty."))) for k, f in enumerate(FIELDS)],
        once(stray, lambda n: when(n > 2, _issue(2, zero, zero, 0, "frontmatter", "warn", F.lit("body"), said("Found ", n, " separator lines; two are expected.")))),
        when(F.size("ss") == 0, _issue(3, zero, zero, 0, "structure", "warn", F.lit("body"), F.lit("The body has no section."))),
        when(F.col("body").rlike(CONTACT) & ~F.col("body").rlike(PHONE) & ~F.col("body").rlike(EMAIL), _issue(7, zero, zero, 0, "explicit_contact", "info", F.lit("body"), F.lit("Contact is asked for without a number or address."))),
    ]

    def short(s: Column, ts: Column, k: Column) -> Column:
        few = F.filter(F.transform(ts, lambda t, j: F.struct(j.alias("sub"), t.alias("t"))), lambda z: (z["sub"] > 0) & (z["t"] < low))
        issue = lambda ps, z: _issue(5, k, z["sub"], 0, "merge_short_h2", "info", trim(F.get(F.split(F.get(ps, z["sub"]), "\n"), 0)), said("Subsection has ", z["t"], " tokens; consider merging it."))
        return once(split_before(s, H2), lambda ps: F.transform(few, lambda z: issue(ps, z)))

    def body(x: Column, k: Column) -> Column:
        s = x["s"]
        return once(F.struct(F.get(x["ts"], F.lit(0)).alias("t"), F.concat(F.lit("# "), title(s)).alias("place")), lambda z: F.concat(
            when(z["t"] < low, _issue(4, k, zero, 0, "token_min", "warn", z["place"], said("Chunk has ", z["t"], f" tokens; at least {low} are expected."))),
            when(z["t"] > high, _issue(4, k, zero, 1, "token_max", "warn", z["place"], said("Chunk has ", z["t"], f" tokens; at most {high} are expected."))),
            when((F.lit(entity) != "") & ~F.contains(F.lower(s), F.lit(entity.lower())), _issue(4, k, zero, 2, "entity", "warn", z["place"], F.lit(f"Entity {entity} does not appear in the body."))),
            short(s, x["ts"], k),
            when(bullets_without_lead(s), _issue(6, k, zero, 0, "bridge_sentence", "info", z["place"], F.lit("A list has no sentence that leads in."))),
        ))

    # The first four fields are an issue's place in the order and differ within a document.
    every = F.sort_array(F.concat(*head, F.flatten(F.transform("sized", body))))
    return d.select(*keys, "markdown", F.transform(every, lambda x: F.struct(*[x[c].alias(c) for c in ISSUE])).alias("issues"))


def validate(docs: DataFrame, *args, keys: tuple[str, ...] = ("doc_index",), **options) -> DataFrame:
    """keys, ord, check, severity, location, message, of documents and options as issue_lists takes
    them; ord numbers a document's issues."""
    found = issue_lists(docs, *args, keys=keys, **options).select(*keys, F.posexplode("issues").alias("ord", "x"))
    return found.select(*keys, (F.col("ord") + 1).alias("ord"), *[F.col(f"x.{c}").alias(c) for c in ISSUE])


def summarize(docs: DataFrame, issues: DataFrame, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """Issues by severity for every document, zeros kept."""
    counts = issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")])
    return docs.select(*keys).join(counts, [*keys], "left").fillna(0, ["error", "warn", "info"])


def rollup(issues: DataFrame, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """Issues and documents with one by severity and check, by severity, and in all: one aggregation over
    grouping sets. level is 0, 1 or 3 (Spark's grouping id); without issues there is the last row alone."""
    sums = issues.rollup("severity", "check").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("issues"), F.count_distinct(*keys).alias("documents"))
    return sums.select("level", "severity", "check", "issues", "documents")


def validate_section(rows: DataFrame, text: str = "text", entity: str = "", keys: tuple[str, ...] = ("section",), **limits) -> DataFrame:
    """Issues of single sections, those about frontmatter aside."""
    block = frontmatter.build(F.lit("x"), F.lit("x"), F.lit("1"), F.lit("x"))
    wrapped = rows.select(*keys, F.concat(block, F.lit("\n"), F.col(text)).alias("markdown"))
    return validate(wrapped, entity=entity, keys=keys, **limits).where("check <> 'frontmatter'")


def _kind(check: Column) -> Column:
    """The fix that an issue asks for, null if none."""
    return F.when(check == "frontmatter", "fix_frontmatter").when(check == "token_min", "merge_short").when(check == "token_max", "shrink").when(check.isin("entity", "bridge_sentence"), "rewrite")


def _tokens(kind: Column, message: Column) -> Column:
    tokens = F.regexp_extract(message, r"(\d+)\s+tokens?", 1)
    return F.when((kind == "fix_frontmatter") | (tokens == ""), 0).otherwise(F.try_to_number(tokens, F.lit("999999999")).cast("int"))


def fix_plan(issues: DataFrame, keys: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """keys, ord, type, location, current_tokens, message: the fixes that issues ask for; of a
    document's frontmatter issues only the first counts."""
    out = issues.withColumn("type", _kind(F.col("check"))).where("type is not null")
    first = F.row_number().over(Window.partitionBy(*keys, "type").orderBy("ord"))
    out = out.withColumn("n", first).where("type <> 'fix_frontmatter' or n = 1")
    return out.select(*keys, "ord", "type", "location", _tokens(F.col("type"), F.col("message")).alias("current_tokens"), "message")


def fixes_of(issues: Column) -> Column:
    """The same of one document's array of issues: an array of (ord, type, location, current_tokens, message)."""
    numbered = F.transform(issues, lambda x, k: F.struct((k + 1).alias("ord"), _kind(x["check"]).alias("type"), x["location"].alias("location"), x["message"].alias("message")))
    first = lambda rows: F.get(F.filter(rows, lambda z: z["type"] == "fix_frontmatter"), F.lit(0))["ord"]
    kept = once(numbered, lambda rows: once(first(rows), lambda at: F.filter(rows, lambda z: (z["type"] != "fix_frontmatter") | (z["ord"] == at))))
    return F.transform(kept, lambda z: F.struct(z["ord"].alias("ord"), z["type"].alias("type"), z["location"].alias("location"), _tokens(z["type"], z["message"]).alias("current_tokens"), z["message"].alias("message")))


def route(fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes made here (frontmatter), and those for a model."""
    return fixes.where("type = 'fix_frontmatter'"), fixes.where("type <> 'fix_frontmatter'")


def fix_documents(docs: DataFrame, form: dict[str, Column], fix_rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs (doc_index, markdown, issues as issue_lists gives them, and other columns) with its fixes made;
    adds ``state``. The frontmatter is rebuilt here from ``form``, then ``fix_rest`` gets the rows with
    ``asked``, the markdown of the documents with other fixes (null: nothing is asked), and their
    ``fix_list``, and adds ``fixed``; null means that the model failed. Nothing is joined or shuffled, and
    what is read more than once should be written first, or the model is called again. States: clean, local, model, failed,
    and form (a frontmatter fix without a whole form: nothing is done)."""
    whole = F.lit(True)
    for f in FIELDS:
        whole = whole & (F.coalesce(form[f].cast("string"), F.lit("")) != "")
    rest = [c for c in docs.columns if c not in ("markdown", "issues")]
    is_here = lambda z: z["type"] == "fix_frontmatter"
    d = docs.withColumn("fixes", fixes_of(F.col("issues"))).withColumn("here", F.exists("fixes", is_here)).withColumn("others", F.filter("fixes", lambda z: ~is_here(z)))
    d = d.withColumn("refused", F.col("here") & ~whole)
    made = F.when(F.col("here") & ~F.col("refused"), frontmatter.replace(F.col("markdown"), frontmatter.build(*[form[f].cast("string") for f in FIELDS]))).otherwise(F.col("markdown"))
    wanted = ~F.col("refused") & (F.size("others") > 0)
    d = d.select(*rest, "here", "refused", wanted.alias("wanted"), made.alias("made"), F.when(wanted, fix_lines(F.col("others"))).alias("fix_list"))
    # A text goes along in one of two columns, not in both.
    asked, left = F.when(F.col("wanted"), F.col("made")), F.when(~F.col("wanted"), F.col("made"))
    d = fix_rest(d.select(*rest, "here", "refused", "wanted", asked.alias("asked"), left.alias("left"), "fix_list"))
    state = F.when(F.col("refused"), "form").when(F.col("wanted") & F.col("fixed").isNull(), "failed").when(F.col("wanted"), "model").when(F.col("here"), "local").otherwise("clean")
    return d.select(*rest, F.coalesce("fixed", "asked", "left").alias("markdown"), state.alias("state"))


def visible(issues: DataFrame) -> DataFrame:
    """Issues shown beside a rewrite: errors, then warnings."""
    return issues.where("severity <> 'info'").withColumn("rank", F.when(F.col("severity") == "error", 0).otherwise(1))
