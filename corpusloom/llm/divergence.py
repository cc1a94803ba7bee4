"""Audit of how the sources of a language diverge in their terms.

Each group (language, source) and each language gives every kept term a share of a milliard, in whole
numbers. Part ``pair`` sums a triangular distance of the shares over all kept terms for every two
sources of a language; part ``term`` has the ten terms that a source uses most beyond its language.

Counts leave the texts as one row for each Arrow batch, group and term. A term that a source lacks has
that source's base share, so a pair's sum is the number of terms times the distance of the bases, plus
corrections: for the terms of one source from a histogram of its shares, for the terms of both from an
equi-join of the counts. No table of all terms by all sources is made. Nor is a group's list of terms
sorted: histograms over the bits of the values, ten at a time from the top, find the value of the tenth
place of every group at once; where more terms have just that value than places are left, histograms
over the bytes of the terms, two at a time, find which come first.

Defined cases: a null text, language or source is empty; rows that repeat a doc_id are documents each; a
language without kept terms has pairs of value 0; an empty table gives no rows; other columns are not
read. A text is read whole in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, counted, table
from .tokens import text_bytes

SHARE, SMOOTH, LEAST_DOCS, TOP = 1_000_000_000, 2, 10, 10
#: Bits of a value (at most SHARE), and those that a histogram is over.
BITS, DIGIT = 30, 10
#: Bytes of a term that a histogram is over.
STEP = 2

#: Letters as they count in a term: A-Z in lower case, 128 and above as they are, others as white space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of one batch."""
    data, at = text_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.take(_LETTER, data)))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    # An empty string stands where a text begins or ends with white space.
    filled = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[filled]
    n_terms = max(1, len(flat.dictionary))
    (l, s) = (x.dictionary_encode() for x in (langs, sources))
    n_sources = max(1, len(s.dictionary))
    group = l.indices.to_numpy().astype(np.int64) * n_sources + s.indices.to_numpy()
    in_doc, n = np.unique(row * n_terms + flat.indices.to_numpy(), return_counts=True)
    key = group[in_doc // n_terms] * n_terms + in_doc % n_terms
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, first) if len(first) else n
    g, t = key[first] // n_terms, key[first] % n_terms
    return pa.RecordBatch.from_arrays([l.dictionary.take(pa.array(g // n_sources)), s.dictionary.take(pa.array(g % n_sources)), flat.dictionary.take(pa.array(t)).cast(pa.string()), pa.array(total, pa.int64()), pa.array(np.diff(np.r_[first, len(key)]), pa.int64())], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents of the group that have the term."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counts(*batch.columns)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """Whole share of a term with n of total occurrences; decimals hold what long can't."""
    return F.expr(f"1 + (cast({SHARE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0))) div cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    scratch = Scratch(docs.sparkSession)
    term = Window.partitionBy("lang", "term")
    kept = (
        term_counts(docs, lang, source, text)
        .select("*", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("n_lang"), (F.col("source") == F.min("source").over(term)).alias("first"))
        .where(F.col("df") >= least_docs)
        .drop("df", "docs")
    )
    kept = scratch.write(kept, "kept-terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"))]).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = {"total": 0, "lang_total": 0, "terms": 0}
    groups = scratch.write(groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(zero).withColumn("base", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "term-groups")
    shares = kept.join(counted(groups), ["lang", "source"]).select("lang", "source", "term", "base", share("n", "total", "terms").alias("p"), share("n_lang", "lang_total", "terms").alias("q"))
    shares = scratch.write(shares.withColumn("value", F.when(F.col("p") > F.col("q"), distance("p", "q"))), "term-shares")
    found = _pairs(groups, shares).unionByName(_terms(shares.where("value is not null").select("lang", "source", "term", "value"), scratch, top))
    return found


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    a, b = groups.select("lang", "source", "base", "terms"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    both_ways = a.join(b, "lang").where("source <> item")
    # Terms of one source against the base of the other: by share, not by term.
    shapes = shares.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("m"))
    alone = shapes.join(b, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (distance("p", "other") - distance("base", "other"))).alias("alone"))
    # Terms of both, each pair once.
    x, y = shares.select("lang", "term", "source", "p", "base"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("base").alias("other"))
    more = distance("p", "r") - distance("p", "other") - distance("base", "r") + distance("base", "other")
    shared = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(more).alias("shared"))
    turned = lambda df, v: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), v)
    value = F.coalesce(F.col("terms") * distance("base", "other"), F.lit(0)) + F.coalesce("alone", F.lit(0)) + F.coalesce("back", F.lit(0)) + F.coalesce("shared", F.lit(0))
    key = ["lang", "source", "item"]
    out = both_ways.join(alone, key, "left").join(turned(alone, "alone").withColumnRenamed("alone", "back"), key, "left").join(shared.unionByName(turned(shared, "shared")), key, "left")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", ranked)


def _terms(values: DataFrame, scratch: Scratch, top: int) -> DataFrame:
    """The ``top`` terms of each group by value, ties by the bytes of the term."""
    key = ["lang", "source"]
    # (group, head, need): need places are left for the values whose leading bits are head.
    limits = values.select(*key).distinct().select(*key, F.lit(0).cast("long").alias("head"), F.lit(top).cast("long").alias("need"))
    down, up = Window.partitionBy(*key).orderBy(F.desc("digit")), Window.partitionBy(*key).orderBy("digit")
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        inside = values.join(counted(limits), key).where(F.shiftright("value", shift + DIGIT) == F.col("head"))
        bars = inside.groupBy(*key, "head", "need", F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).count()
        bars = bars.select("*", F.sum("count").over(down).alias("sofar"), F.row_number().over(up).alias("from_below"))
        # The bar that has the last place, or the lowest if there are places for all.
        reached = bars.where("(sofar >= need and sofar - count < need) or (from_below = 1 and sofar < need)")
        limits = scratch.write(reached.select(*key, (F.col("head") * (1 << DIGIT) + F.col("digit")).alias("head"), (F.col("need") - F.col("sofar") + F.col("count")).alias("need"), F.col("count").alias("ties")), f"limits-{shift}")
        if shift:
            limits = limits.drop("ties")
    placed = values.join(counted(limits), key)
    sure = placed.where("value > head or (value = head and ties <= need)").select(*key, "term", "value")
    ties = scratch.write(placed.where("value = head and ties > need").select(*key, "term", "value", F.col("term").cast("binary").alias("bytes")), "ties")
    # (group, begin, need): need places are left for the tied terms that begin with these bytes.
    begins, at = limits.where("ties > need").select(*key, F.unhex(F.lit("")).alias("begin"), "need"), 0
    while not begins.isEmpty():
        inside = ties.join(counted(begins), key).where(F.col("bytes").substr(1, at) == F.col("begin"))
        digit = F.col("bytes").substr(at + 1, STEP).alias("digit")
        bars = inside.groupBy(*key, "begin", "need", digit).agg(F.count("*").alias("count"))
        bars = scratch.write(bars.withColumn("sofar", F.sum("count").over(up)), f"bytes-{at}")
        whole = bars.where("sofar <= need").select(*key, F.concat("begin", "digit").alias("begin"))
        sure = sure.unionByName(ties.join(counted(whole), key).where(F.col("bytes").substr(1, at + STEP) == F.col("begin")).select(*key, "term", "value"))
        begins = bars.where("sofar > need and sofar - count < need").select(*key, F.concat("begin", "digit").alias("begin"), (F.col("need") - F.col("sofar") + F.col("count")).alias("need"))
        at += STEP
    ranked = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item"))
    return sure.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", ranked)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL_OP11 = f"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words from documents),
w as (select k, lang, source, unnest(words) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by 1, 2 having count(distinct k) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by 1),
c as (select w.lang, w.source, w.term, count(*)::hugeint as n from w semi join kept on w.lang = kept.lang and w.term = kept.term group by 1, 2, 3),
t as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c on g.lang = c.lang and g.source = c.source group by 1, 2),
s as (
  select t.lang, t.source, kept.term, coalesce(c.n, 0) as n,
    1 + ({SHARE}::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (t.total + {SMOOTH} * v.v) as p,
    1 + ({SHARE}::hugeint * (kept.n + {SMOOTH})) // (v.total + {SMOOTH} * v.v) as q
  from t join v on t.lang = v.lang join kept on kept.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3) x
  on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from s where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
