"""Large dictionaries in one pass, files that arrive as upserts, frontmatter without Python for flat blocks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dictionary, frontmatter
from corpusloom.functions.text import has_term
from corpusloom.streaming.ingest import DocumentSet, watch


def terms_of(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def test_terms_equal_the_regular_expression(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "b", "1", "_", " ", ".", "é", "É", "ſ", "K", "k", "ß", "İ", "ı", "i", "+", "(", "\U0001f600", "ǅ", "ǆ"]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    terms = sorted({word(rng.randrange(1, 4)) for _ in range(150)})
    docs = spark.createDataFrame([(2**60 + i, word(rng.randrange(30))) for i in range(40)] + [(None, "a b"), (7, None)], "id long, text string")
    want = {(r["id"], r["term"]) for r in docs.crossJoin(F.broadcast(terms_of(spark, terms))).where(has_term(F.col("text"), F.col("term"))).collect()}
    got = dictionary.found_terms(docs, terms_of(spark, [*terms, "", None, terms[0]]), ["id"]).collect()
    assert len(got) == len(want) > 50 and {(r["id"], r["term"]) for r in got} == want
    blocks = dictionary.found_terms(docs, terms_of(spark, terms), ["id"], block_bytes=100).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_counts_places_and_parts(spark):
    docs = spark.createDataFrame([(1, "x Aa aa-aaa aa")], "id long, text string")
    got = dictionary.found_terms(docs, terms_of(spark, ["aa", "AA", "x a"]), ["id"]).collect()
    assert sorted((r["term"], r["n"], r["first"]) for r in got) == [("AA", 3, 2), ("aa", 3, 2)]
    got = dictionary.found_terms(docs, terms_of(spark, ["aa", "x A"]), ["id"], exact=True).collect()
    assert sorted((r["term"], r["n"], r["first"]) for r in got) == [("aa", 4, 5), ("x A", 1, 0)]
    assert dictionary.found_terms(docs, terms_of(spark, []), ["id"]).count() == 0


def test_time_is_flat_in_the_number_of_terms():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = " ".join(word() for _ in range(100_000))
    took = {}
    for n in (100, 10_000):
        automaton = dictionary._automaton(f"test-{n}", sorted({word() for _ in range(n)}), False)
        best = []
        for _ in range(3):
            start = time.process_time()
            dictionary._occurrences(automaton, text, False)
            best.append(time.process_time() - start)
        took[n] = min(best)
    assert took[10_000] < 10 * took[100] + 0.05, took


def rows(kept, until=None):
    return [(r["place_batch"], r["place_ord"], r["name"], r["markdown"]) for r in kept.current(until).orderBy("place_batch", "place_ord", "name").collect()]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    kept = DocumentSet(spark, f"file://{tmp_path}/set")
    assert rows(kept) == [] and kept.compact() is None
    batch = lambda *x: spark.createDataFrame(list(x), "ord long, name string, markdown string")
    assert kept.apply(batch((1, "a", "1"), (2, "b", "2"), (3, "a", "1b")), 0)
    assert kept.apply(batch((9, "c", None), (8, "a", "new")), 1)
    first, both = [(0, 1, "a", "1b"), (0, 2, "b", "2")], [(0, 1, "a", "new"), (0, 2, "b", "2"), (1, 9, "c", None)]
    assert rows(kept) == both and rows(kept, 0) == first
    assert not kept.apply(batch((1, "z", "other")), 1) and rows(kept) == both
    assert kept.compact() == 1 and kept.compact() == 1 and rows(kept) == both and rows(kept, 0) == first
    assert kept.apply(batch((1, "b", "3")), 2) and kept.apply(batch((1, "x", "y")).limit(0), 3)
    assert rows(kept) == [(0, 1, "a", "new"), (0, 2, "b", "3"), (1, 9, "c", None)] == rows(DocumentSet(spark, kept.path))
    # What a failed attempt left is not read.
    batch((1, "lost", "x")).selectExpr("name", "markdown", "9L batch", "ord", "9L place_batch", "ord place_ord").write.parquet(f"{kept.path}/data/{'0' * 32}")
    assert len(rows(kept)) == 3 and kept.compact() == 3 and len(rows(kept)) == 3


def test_files_that_arrive(spark, tmp_path):
    folder, kept = tmp_path / "in", DocumentSet(spark, f"file://{tmp_path}/set")
    folder.mkdir()
    run = lambda: watch(spark, str(folder), kept, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(60)
    (folder / "b.md").write_text("# B\n\nb")
    (folder / "c.txt").write_text("no")
    assert run()
    (folder / "sub").mkdir()
    (folder / "sub" / "b.md").write_text("# B2\n")
    (folder / "a.Markdown").write_text("# A\n")
    assert run() and run()
    got = rows(kept)
    assert [(b, n, m) for b, _, n, m in got if b == 0] == [(0, "b.md", "# B2\n")]
    assert [(b, n, m) for b, _, n, m in got if b != 0] == [(1, "a.Markdown", "# A\n")]


def test_only_odd_blocks_pass_through_python(spark, capfd):
    flat, odd = '---\ntopic: "x"\n---\nbody', "---\ntopic: >\n  folded\n---\nbody"
    docs = spark.createDataFrame([(k, odd if k == 7 else flat if k % 2 else "none") for k in range(200)], "doc_index long, markdown string")
    out = frontmatter.parse(docs)
    got = {r["doc_index"]: (r["fm_present"], r["topic"], r["body"]) for r in out.collect()}
    assert got[7] == (True, "folded", "body") and got[9] == (True, "x", "body") and got[8] == (False, None, "none") and len(got) == 200
    out.explain("formatted")
    plan = capfd.readouterr().out
    assert "ArrowEvalPython" in plan and "Union" in plan
