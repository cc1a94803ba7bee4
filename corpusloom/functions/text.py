"""Text helpers with one meaning in every engine: trims, splits, boundaries, rounding.

Lengths and positions are in code points. White space is the set below wherever a rule says
"space"; word boundaries are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, ASCII and beyond, that trims take off.
SPACE = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: An ASCII word boundary; Java's own is Unicode-aware.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WORD = "[A-Za-z0-9_]+"
#: Units counted by the word-like token counter.
UNIT = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value found once a row. What stands in a lambda is found anew for each element,
    and what holds a lambda anew wherever it is named: common expressions aren't shared there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def split_before(c: Column, head: str) -> Column:
    """Pieces of c, each from a line start where ``head`` matches to the next such line."""
    return F.split(c, rf"(?m)(?=^{head})")


def blocks(c: Column, head: str) -> Column:
    """Trimmed, non-empty pieces of split_before."""
    return F.filter(F.transform(split_before(c, head), trim), lambda x: x != "")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def round_half_up(c: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def escape(term: Column) -> Column:
    return F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def has_term(text: Column, term: Column) -> Column:
    """Whether a term stands in the text between ASCII word boundaries, in any case."""
    # The term is looked for first, so that edges are tried only where it stands.
    return (term != "") & F.rlike(text, F.concat(F.lit("(?iu)"), escape(term), F.lit(f"(?<={EDGE}"), escape(term), F.lit(rf"){EDGE}")))


def words(text: Column) -> Column:
    """ASCII words in lower case."""
    return F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORD})"), F.lit(1)), F.lower)


def significant_words(text: Column, stop: list[str]) -> Column:
    """Runs of letters and figures in lower case, three long or more, without stop words."""
    found = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(stop))


def counted_words(words: Column) -> Column:
    """Array of (term, tf), one for each distinct word, in order."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda k: (k < F.size(s)) & ~F.get(s, k).eqNullSafe(F.get(s, k - 1)))
    count = lambda s: once(starts(s), lambda at: F.transform(at, lambda k, i: F.struct(F.get(s, k).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - k).cast("long").alias("tf"))))
    return once(F.sort_array(words), count)


def units(text: Column) -> Column:
    """Number of word-like units: a token count that SQL can express."""
    return F.regexp_count(text_or_empty(text), F.lit(UNIT)).cast("int")


def first_heading(text: Column) -> Column:
    """Text of the first heading of level one to three."""
    return trim(F.regexp_extract(text, rf"(?m)^(#{{1,3}})\s+(.+?)\s*$", 2))


def first_h1(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)


def snippet(text: Column, size: int = 240) -> Column:
    return F.when(F.length(text) > size, F.concat(rtrim(F.substring(text, 1, size)), F.lit("..."))).otherwise(text)


def clamp(text: Column, size: int = 4000) -> Column:
    # Fixed value: the mark of a cut.
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("\n…[truncated]"))).otherwise(text)


def strip_orphan_fences(text: Column) -> Column:
    """Lines that are nothing but a fence become empty."""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*```\w*[ \t]*$", "")
    return F.concat(trim(collapse_blank_lines(bare)), F.lit("\n"))


def strip_json_fence(text: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(trim(text), r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", ""))


def salvage_json(text: Column, schema: str) -> Column:
    """from_json of the text; if that fails, of what stands between its outermost brackets."""
    bare = strip_json_fence(text)
    kind = r"(?s)(\[.*\])" if schema.startswith("array") else r"(?s)(\{.*\})"
    valid = F.get_json_object(bare, "$").isNotNull()
    return F.from_json(F.when(valid, bare).otherwise(F.regexp_extract(bare, kind, 1)), schema)


def object_key(name: Column) -> Column:
    """A file name made safe for an object store's key."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")


def similarity_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "mid").otherwise("low")


def size_flag(tokens: Column, low: int = 70, high: int = 512) -> Column:
    return F.when(tokens > high, "oversize").when(tokens < low, "undersize").otherwise("ok")


def locate_line(text: Column, location: Column) -> Column:
    """1-based line that an issue's location names; 1 if none is found."""
    return F.get(locate_lines(text, F.array(location)), F.lit(0))


def locate_lines(text: Column, locations: Column) -> Column:
    """The same for an array of locations. The text is cut into lines once, and headings and field
    lines, which nearly all locations name, are picked out once; of lines that fit, the first in the best way wins."""
    lines = F.transform(F.split(text, "\n"), lambda x, k: F.struct((k + 1).alias("line"), x.alias("x"), trim(x).alias("bare")))
    heads = lambda ls: F.transform(F.filter(ls, lambda s: s["bare"].startswith("#")), lambda s: F.struct(s["line"], s["bare"], s["x"].rlike(r"\A#\s+").alias("h1"), F.when(s["x"].rlike(r"\A#{1,3}\s"), trim(F.regexp_replace(s["x"], r"\A#{1,3}\s+", ""))).alias("name")))
    named = lambda ls: F.filter(F.transform(ls, lambda s: F.struct(s["line"], F.lower(F.regexp_extract(s["x"], r"\A\s*(\w+)\s*:", 1)).alias("name"))), lambda s: s["name"] != "")
    first = lambda rows, fits: F.get(F.filter(rows, fits), F.lit(0))["line"]

    def locate(z: Column, place: Column) -> Column:
        field = F.lower(F.regexp_extract(place, r"\Afrontmatter\.(\w+)", 1))
        head = trim(F.regexp_extract(place, r"\A#{1,3}[ ]+(.*)\z", 1))
        by_name = once(head, lambda h: first(z["heads"], lambda s: s["name"] == h))
        by_head = F.coalesce(first(z["heads"], lambda s: s["bare"] == place), by_name)
        by_field = once(field, lambda f: first(z["fields"], lambda s: s["name"] == f))
        found = F.when(place.isin("", "top"), F.lit(1)).when(field != "", by_field).when(place.rlike(r"\A#{1,3} "), by_head)
        found = found.when(place == "body", first(z["heads"], lambda s: s["h1"])).otherwise(first(z["lines"], lambda s: F.contains(s["x"], place)))
        return F.coalesce(found, F.lit(1)).cast("int")

    index = lambda ls: F.struct(ls.alias("lines"), heads(ls).alias("heads"), named(ls).alias("fields"))
    return once(once(lines, index), lambda z: F.transform(locations, lambda a: once(trim(text_or_empty(a)), lambda place: locate(z, place))))


def highlight(text: Column, shared: Column) -> Column:
    """Alternating runs of letters or figures and of other characters; hit marks shared words."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(runs, lambda x: F.struct(x.alias("run"), F.array_contains(shared, F.lower(x)).alias("hit")))
