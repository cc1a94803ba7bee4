"""Candidate pairs by a rising bound against brute force, with words that all sections hold."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import neardup
from corpusloom.plans.queries import _one_section


def brute(rows, threshold, most):
    tfs = [Counter(w for w in text.split() if len(w) > 2) for *_, text in rows]
    df, n = Counter(w for tf in tfs for w in tf), len(rows)
    vectors = [{w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in tf.items()} for tf in tfs]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    out = []
    for i, j in itertools.combinations(sorted(range(n), key=lambda k: rows[k][:2]), 2):
        if rows[i][0] != rows[j][0] and norms[i] and norms[j]:
            cosine = sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / (norms[i] * norms[j])
            if cosine >= threshold:
                out.append((math.floor(cosine * 10000 + 0.5) / 10000, rows[i][:2], rows[j][:2]))
    out.sort(key=lambda x: (-x[0], x[1], x[2]))
    return [(*a, *b, s) for s, a, b in out[:most]]


def sections(n, seed, docs=9):
    """Every section has the words ``everywhere`` and ``common``; some are copies or near copies."""
    r = random.Random(seed)
    words = [f"word{k}" for k in range(60)]
    out = []
    for k in range(n):
        if k % 7 == 3 and out:
            text = out[r.randrange(len(out))][2].replace(r.choice(words), r.choice(words))
        else:
            text = " ".join(["everywhere", "common"] + [words[min(59, int(r.expovariate(0.08)))] for _ in range(r.randrange(1, 14))])
        out.append((r.randrange(docs), k, text))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_index int, section_index int, text string")
    return sorted((tuple(r)[1:] for r in neardup.candidate_pairs(df, stop=["zzz"], **kw).collect()), key=lambda r: (-r[4], r[0], r[1], r[2], r[3]))


@pytest.mark.parametrize("chunk,spend,threshold,most", [(2048, 2, 0.12, 80), (4, 0, 0.12, 40), (3, 0, 0.5, 10_000), (5, 0, 0.12, 10_000)])
def test_equals_brute_force_with_words_in_all_sections(spark, monkeypatch, chunk, spend, threshold, most):
    """Small chunks send all words through chunk pairs; without a spend each span is a block of its own."""
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "SPEND", spend)
    monkeypatch.setattr(neardup, "SPEND_LEAST", 50_000 if spend else 0)
    monkeypatch.setattr(neardup, "WIDER", 16 if spend else 4)
    rows, trace = sections(90, 7), []
    assert found(spark, rows, threshold=threshold, most=most, trace=trace) == brute(rows, threshold, most)
    bounds = [t for _, _, t, _ in trace]
    assert bounds == sorted(bounds)


def test_fewer_than_two_documents_compare_nothing(spark):
    trace = []
    assert found(spark, [(1, k, "same words here") for k in range(4)], trace=trace) == []
    assert found(spark, [], trace=trace) == [] and trace == []
    assert found(spark, [(1, 0, None), (2, 0, ""), (3, 0, None)], trace=trace) == []


def test_rows_compared_follow_the_input(spark):
    """Ten times the sections: no more than ten times the pairs that are compared in whole."""
    compared = {}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        trace = []
        neardup.candidate_pairs(_one_section(spark, f"/root/testdata/{sf}"), trace=trace).collect()
        compared[sf] = sum(n for *_, n in trace)
    assert compared["sf0.1"] <= 10 * max(compared["sf0.01"], 100) and compared["sf0.01"] <= 10 * max(compared["sf0.001"], 100)


def test_words_of_a_class_are_counted_in_its_row(spark):
    d = spark.createDataFrame([(0, ["b", "a", "b", "", "a", "b"]), (1, ["x"]), (2, [])], "k int, w array<string>")
    got = {r["k"]: [tuple(x) for x in r["c"]] for r in d.select("k", neardup.counted_words(F.col("w")).alias("c")).collect()}
    assert got == {0: [("", 1), ("a", 2), ("b", 3)], 1: [("x", 1)], 2: []}
    rows = spark.createDataFrame([(0, "alpha beta beta"), (1, "alpha beta beta"), (2, "beta gamma")], "at int, text string")
    # Postings carry short numbers, and copies count in the document frequencies.
    p = neardup._postings(neardup._classes(rows, ["zzz"]))
    assert dict(p.dtypes)["class"] == "bigint"
    assert sorted((r["term"], r["df"]) for r in p.collect()) == [("alpha", 2), ("beta", 3), ("beta", 3)]


def test_postings_are_shuffled_as_counts(spark):
    """F14 to F18: below the shuffle by class there are counts, no weights."""
    rows = spark.createDataFrame([(0, "alpha beta beta"), (1, "beta gamma")], "at int, text string")
    plan = neardup._postings(neardup._classes(rows, ["zzz"]))._jdf.queryExecution().optimizedPlan().toString()
    above, found, below = plan.partition("RepartitionByExpression [class")
    assert found and "ln(" in above and "ln(" not in below
