"""The stored index against a scan of all postings, and what it leaves unread."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bm25_index, retrieve
from corpusloom.plans.queries import _sections, _whole_questions


def rows(df):
    """Rows with scores to three places: sums in another order may round the fourth apart."""
    return sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect())


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    return [(r.randrange(3), k, None if k % 11 == 5 else " ".join(["all"] * r.randrange(2) + [words[min(39, int(r.expovariate(0.15)))] for _ in range(r.randrange(0, 30))])) for k in range(n)]


@pytest.mark.parametrize("per_stripe,k", [(1, 3), (4, 5), (1000, 2)])
@pytest.mark.parametrize("by", [[], ["part"]])
def test_same_rows_as_a_scan(spark, tmp_path, per_stripe, k, by):
    chunks = spark.createDataFrame(corpus(150, k), "part int, chunk_index long, text string").where("part < 2 or chunk_index % 2 = 0")
    asked = spark.createDataFrame([(1, "w1 w2 w30"), (2, "all"), (3, "  "), (4, None), (5, "nothing of this"), (6, "w3 w3 w3 all W1!"), (7, "w39")], "query_id int, query string")
    index = bm25_index.build(chunks, f"file://{tmp_path}/i", corpus=by, per_stripe=per_stripe, buckets=3)
    again = bm25_index.open_index(spark, f"file://{tmp_path}/i")
    for fill in (True, False):
        want = rows(retrieve.search(chunks.withColumn("text", F.coalesce("text", F.lit(""))), asked, k=k, corpus=by, fill=fill))
        assert rows(bm25_index.search(index, asked, k=k, fill=fill)) == want
    assert rows(bm25_index.search(again, asked, k=k, fill=False)) == want


def test_blocks_are_skipped(spark, tmp_path):
    """Of a few words' blocks most are never read; for whole passages, whose words are in every stripe, some."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("chunk_index"), "text")
    index = bm25_index.build(docs, f"file://{tmp_path}/i")
    whole = _whole_questions(spark, "/root/testdata/sf0.01")
    few = whole.select("query_id", F.array_join(F.slice(F.split("query", " "), 1, 3), " ").alias("query"))
    trace = []
    got = rows(bm25_index.search(index, few, trace=trace))
    assert got == rows(retrieve.search(docs, few))
    bm25_index.search(index, whole, trace=trace)
    (met, read), (met_whole, read_whole) = trace
    assert 0 < read < met / 2 and read_whole < met_whole


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_index long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    assert bm25_index.search(bm25_index.build(none, f"file://{tmp_path}/a"), asked).count() == 0
    blank = spark.createDataFrame([(1, " "), (2, None)], "chunk_index long, text string")
    index = bm25_index.build(blank, f"file://{tmp_path}/b")
    assert bm25_index.search(index, asked).count() == 0
    assert bm25_index.search(index, asked.limit(0)).count() == 0


def test_only_the_words_folders_are_read(spark, tmp_path):
    chunks = _sections(spark, "/root/testdata/sf0.001")
    index = bm25_index.build(chunks, f"file://{tmp_path}/i", buckets=16)
    asked = spark.createDataFrame([(1, "de")], "query_id int, query string")
    plan = bm25_index.search(index, asked, fill=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and len(list(tmp_path.glob("i/blocks/bucket=*"))) == 16


@pytest.mark.parametrize("small", [0, 10_000])
def test_corpora_with_and_without_bounds(spark, tmp_path, monkeypatch, small):
    """Corpora of a few stripes are scored at once, larger ones by bounds; parts and slices of queries are small."""
    monkeypatch.setattr(bm25_index, "SMALL", small)
    monkeypatch.setattr(bm25_index, "PART", 16)
    monkeypatch.setattr(bm25_index, "TOGETHER", 2)
    monkeypatch.setattr(bm25_index, "SEEDS", 2)
    chunks = spark.createDataFrame(corpus(200, 9), "part int, chunk_index long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w30"), (2, "all"), (3, "w3 w3 w3 all W1!"), (4, "w39"), (5, "w0 w5")], "query_id int, query string")
    want = rows(retrieve.search(chunks.withColumn("text", F.coalesce("text", F.lit(""))), asked, k=3, corpus=["part"]))
    trace = []
    index = bm25_index.build(chunks, f"file://{tmp_path}/i", corpus=["part"], per_stripe=4)
    assert rows(bm25_index.search(index, asked, k=3, trace=trace)) == want
    assert 0 < trace[0][1] <= trace[0][0]


def test_chunks_are_made_once_and_questions_are_not_shuffled(spark, tmp_path):
    """The lineage of the chunks runs once however many tables are built; only parts are shuffled for their scores."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chunks = spark.createDataFrame(corpus(120, 4), "part int, chunk_index long, text string").mapInArrow(count, "part int, chunk_index long, text string")
    index = bm25_index.build(chunks, f"file://{tmp_path}/i", corpus=["part"])
    assert made.value == 120
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.lit("all w1 w2").alias("query"))
    plan = bm25_index.search(index, asked, fill=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "qf" not in plan
