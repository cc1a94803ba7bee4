"""Small cases derived by hand, one for each rule that is easy to get wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter, text as T
from corpusloom.operators import backends, chunking, edits, neardup, noise, retrieve, suggest, validate
from corpusloom.sources import corpus
from corpusloom.streaming import sse


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_index int, markdown string")


@pytest.mark.parametrize(
    ("md", "present", "body"),
    [
        ("  \n---\na: 1\n---\n\n\n# X", True, "# X"),
        ('---\ntopic: "a---b"\n---\n# X', False, 'b"\n---\n# X'),
        ("---\nfoo", False, "---\nfoo"),
        ("", False, ""),
        (None, False, ""),
        (" plain ", False, " plain "),
    ],
)
def test_frontmatter(spark, md, present, body):
    row = frontmatter.parse(docs(spark, md)).first()
    assert (row["fm_present"], row["body"]) == (present, body)


def test_frontmatter_fields(spark):
    row = frontmatter.parse(docs(spark, '---\ndepartment: "A"\ntopic:\ncourse_id: 0\n---\nx')).first()
    assert (row["department"], row["topic"], row["course_id"], row["course_name"]) == ("A", None, "0", None)
    row = frontmatter.parse(docs(spark, "---\ntopic: >\n  folded\n  text\ncourse_id: 7\n---\nx"), general=True).first()
    assert row["fm_present"] and row["topic"].split() == ["folded", "text"] and row["course_id"] == "7"


def test_header_blocks(spark):
    fence = "`" * 3
    rows = chunking.chunk(docs(spark, f"pre\n# A\nx\n#### B\n## C\n{fence}\n# d")).orderBy("chunk_index").collect()
    assert [r["header"] for r in rows] == ["", "A", "C", "d"]
    assert chunking.chunk(docs(spark, " \n ")).count() == 0


def fold(spark, tokens):
    rows = spark.createDataFrame([([(f"p{i}", t) for i, t in enumerate(tokens)],)], "ps array<struct<p:string,t:int>>")
    return [list(g) for g in rows.select(chunking.fold(F.col("ps")).alias("g")).first()["g"]]


def test_fold(spark):
    assert fold(spark, [300, 60, 300]) == [["p0", "p1"], ["p1", "p2"]]
    assert fold(spark, [700]) == [["p0"]]
    assert fold(spark, [300, 300]) == [["p0"], ["p1"]]
    assert fold(spark, []) == []


def checks(spark, md, **kw):
    return [(r["check"], r["location"]) for r in validate.validate(docs(spark, md), low=0, **kw).orderBy("ord").collect()]


def test_issues(spark):
    need = [("frontmatter", "top"), *[("frontmatter", f"frontmatter.{f}") for f in ("department", "topic", "course_id", "course_name")]]
    assert checks(spark, "plain text") == need
    assert checks(spark, "") == [*need, ("structure", "body")]
    for md, bad in (("# T\n**Label:**\n- a", 0), ("# T\nIntro:\n\n\n- a", 0), ("# T\nIntro:\n\n\n\n- a", 1), ("# T\nIntro:\n- a\n  more\n- b", 1), ("- a", 1)):
        assert [c for c, _ in checks(spark, md)].count("bridge_sentence") == bad, md


def test_fix_plan(spark):
    issues = validate.validate(docs(spark, "# T\nx y z"))
    rows = validate.fix_plan(issues).orderBy("ord").collect()
    assert [(r["type"], r["current_tokens"]) for r in rows] == [("fix_frontmatter", 0), ("merge_short", 5)]


@pytest.mark.parametrize(
    ("md", "cleaned", "kept"),
    [
        ("# Thank you", "", 0),
        ("# A\nbody of it\nmore\n\n# B\nbody\nmore\n\n# Q & A", None, 3),
        ("# A\nx\ny\nPage 3 of 9\npage 3 of 9", "# A\nx\ny\npage 3 of 9", 1),
    ],
)
def test_noise(spark, md, cleaned, kept):
    row = noise.filter_noise(docs(spark, md)).first()
    assert row["kept_slides"] == kept and (cleaned is None or row["cleaned"] == cleaned)


def test_bm25(spark):
    chunks = spark.createDataFrame([(0, "# apple banana"), (1, "# banana"), (2, None)], "chunk_index long, text string").where("chunk_index < 2")
    q = spark.createDataFrame([(0, "apple"), (1, " ")], "query_id long, query string")
    assert [(r["chunk_index"], r["score"]) for r in retrieve.search(chunks, q).orderBy("rank").collect()] == [(0, 0.6027), (1, 0.0)]


def test_candidate_pairs(spark):
    rows = spark.createDataFrame([(0, 0, "# modal usaha"), (1, 0, "# modal kerja"), (1, 1, "# lain sekali")], "doc_index int, section_index int, text string")
    assert [(r["pair_id"], r["similarity"]) for r in neardup.candidate_pairs(rows.where("section_index = 0")).collect()] == [("0:0__1:0", 0.3361)]
    same = spark.createDataFrame([(0, 0, "aaa bbb"), (0, 1, "aaa bbb"), (2, 0, "aaa bbb"), (2, 1, "")], "doc_index int, section_index int, text string")
    assert [r["pair_id"] for r in neardup.candidate_pairs(same).collect()] == ["0:0__2:0", "0:1__2:0"]
    assert neardup.candidate_pairs(same.where("doc_index = 0")).count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.35, 0.95])
def test_candidate_pairs_beside_brute_force(spark, threshold):
    rng = random.Random(7)
    words = [f"word{chr(97 + k)}" for k in range(26)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(26)], k=rng.choice([1, 4, 12, 60]))) for _ in range(60)]
    texts += [texts[30], texts[31] + " wordz"]
    rows = spark.createDataFrame([(k, 0, x) for k, x in enumerate(texts)], "doc_index int, section_index int, text string")
    vectors = {}
    for r in neardup.weights(rows, ["doc_index"]).collect():
        vectors.setdefault(r["doc_index"], {})[r["term"]] = r["w"]
    norm = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vectors.items()}
    cosine = {(a, b): sum(w * vectors[b].get(x, 0) for x, w in vectors[a].items()) / norm[a] / norm[b] for a in vectors for b in vectors if a < b}
    got = {(r["a_doc"], r["b_doc"]): r["similarity"] for r in neardup.candidate_pairs(rows, threshold, 5_000).collect()}
    assert set(got) == {k for k, v in cosine.items() if v >= threshold}
    assert all(abs(v - cosine[k]) < 6e-5 for k, v in got.items())


def test_delete_and_replace(spark):
    md = "A\n\n# X\nx\n\n# Y\ny\n"
    assert one(spark, md, lambda c: edits.delete_section(c, F.lit("# X\nx"))) == "A\n\n# Y\ny\n"
    assert one(spark, md, lambda c: edits.delete_section(c, F.lit("# Z"))) == md
    assert one(spark, md, lambda c: edits.replace_first(c, F.lit("# X\nx"), F.lit("$& $1"))) == "A\n\n$& $1\n\n# Y\ny\n"


def test_verdicts(spark):
    reply = '[{"pair_id":"1","verdict":"overlap","similarity":1.7,"dominant":"a"},{"pair_id":"2","verdict":"distinct","similarity":"0.5","dominant":"c"},{"pair_id":"3","verdict":"maybe"},{"verdict":"distinct"}]'
    rows = backends.read_verdicts(spark.createDataFrame([(reply,), ("no json",), (None,)], "reply string")).orderBy("pair_id").collect()
    assert [(r["pair_id"], r["similarity"], r["dominant"]) for r in rows] == [("1", 1.0, "a"), ("2", 0.0, "neither")]


def test_suggestions(spark):
    rows = spark.createDataFrame([(0, 0, "definisi pengertian what is apa itu kebijakan"), (0, 1, "acara"), (0, 2, "policy")], "doc_index int, chunk_index int, text string").withColumn("topic", F.lit(""))
    assert [(r["chunk_index"], r["category"]) for r in suggest.suggest(rows).orderBy("chunk_index").collect()] == [(1, "role_tag"), (2, "question_hook")]
    assert one(spark, "# Title\nb", lambda c: suggest.insert_term(c, F.lit("X1"))) == "# Title (X1)\nb"
    assert one(spark, "# T (a)\nb", lambda c: suggest.insert_term(c, F.lit("X1"))).startswith("# T (a)\n\n")


def test_text(spark):
    fence = "`" * 3
    assert one(spark, f"{fence}md\nx\n\n\n\ny\n{fence}\n", T.strip_orphan_fences) == "x\n\ny\n"
    assert one(spark, "Café", lambda c: T.has_term(c, F.lit("caf"))) is True
    assert one(spark, "Café", T.words) == ["caf"]
    assert one(spark, "#\n\nLate", T.first_heading) == "Late"


def test_upsert(spark):
    s = "ord int, name string, markdown string"
    out = corpus.upsert(spark.createDataFrame([(0, "a", "A"), (1, "b", "B")], s), spark.createDataFrame([(0, "c", "C"), (1, "a", "A2")], s))
    assert [(r["name"], r["markdown"]) for r in out.orderBy("place_batch", "place_ord").collect()] == [("a", "A2"), ("b", "B"), ("c", "C")]


def event(text):
    import json

    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]}) + "\n"


def test_sse(spark):
    fence = "`" * 3
    parts = [event(fence), event("yaml\n---"), "data: oops\n" + event("\nx")[:20], event("\nx")[20:], "data: [DONE]\n", event("late"), "data: unfinished"]
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate(parts)], "stream_id string, seq long, chunk string")
    assert sse.decode(rows).first()["text"] == "---\nx"
    state, out = ("", False, False, False), []
    for p in parts:
        state, more = sse.feed(state, [p])
        out += more
    assert "".join(out) == "---\nx"


def test_sse_stream(spark, tmp_path):
    rows = [("a", 0, event("he")), ("a", 1, event("llo")), ("b", 0, event("x"))]
    spark.createDataFrame(rows, "stream_id string, seq long, chunk string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq long, chunk string").parquet(str(tmp_path / "in"))
    q = sse.decode_stream(stream).writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["stream_id"], r["delta"]) for r in spark.table("deltas").collect()) == [("a", "he"), ("a", "llo"), ("b", "x")]


def test_backend_failure_keeps_rows(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string")

    def broken(prompts):
        raise ValueError

    assert [r["reply"] for r in backends.call(rows, "prompt", broken).collect()] == [None, None]
    with pytest.raises(backends.NotConfigured):
        backends.route_model({})


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.Markdown").write_text("# C\n")
    assert sorted(r["doc_name"] for r in corpus.read_markdown(spark, str(tmp_path)).collect()) == ["a.md", "c.Markdown"]
    zips = corpus.write_zips(corpus.read_markdown(spark, str(tmp_path)), f"file://{tmp_path}").collect()
    assert sum(r["files"] for r in zips) == 2


def test_contact_is_sought_in_the_whole_body(spark):
    assert ("explicit_contact", "body") in checks(spark, "# A\ncontact us\n# B\nby mail")
    assert "explicit_contact" not in [c for c, _ in checks(spark, "# A\ncontact us\n# B\n+49 30 1234567")]
    assert "explicit_contact" not in [c for c, _ in checks(spark, "# A\nContact me\n# B\na.b%c@x-y.org")]


def test_fences_leave_an_empty_line(spark):
    from corpusloom.functions.text import strip_orphan_fences

    rows = spark.createDataFrame([("a\n```\nb",), ("```md\n# x\n```",)], "t string")
    assert [r[0] for r in rows.select(strip_orphan_fences(F.col("t"))).collect()] == ["a\n\nb\n", "# x\n"]


def test_frontmatter_of_any_yaml(spark):
    md = "---\ndepartment: D\ntopic: T\ncourse_id: 7\ncourse_name: N\ntags:\n  - a\n  - b\nowner:\n  name: x\n---\n# X"
    (r,) = frontmatter.parse(docs(spark, md)).collect()
    assert (r["fm_present"], r["department"], r["topic"], r["course_id"], r["course_name"], r["body"]) == (True, "D", "T", "7", "N", "# X")
    assert "frontmatter" not in [c for c, _ in checks(spark, md)]
    (r,) = frontmatter.parse(docs(spark, "---\nother:\n  - a\n---\n# X")).collect()
    assert (r["fm_present"], r["topic"]) == (True, None)
    (r,) = frontmatter.parse(docs(spark, "---\na: [b\n---\n# X")).collect()
    assert not r["fm_present"]
