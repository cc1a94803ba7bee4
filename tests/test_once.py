"""What a row needs once is found once, with the results that finding it again and again gave."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import noise, validate


def times(column, what):
    return column._jc.toString().lower().count(what)


def test_trims_take_the_same_white_space(spark):
    pattern = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    rows = [(f"{chr(c)}a{chr(c)} b{chr(c)}",) for c in [*range(1, 0x300), *range(0x1600, 0x1700), *range(0x1F00, 0x2100), 0x3000, 0xFEFF, 0x1F600]] + [("",), (" 　",), (None,)]
    d = spark.createDataFrame(rows, "x string")
    x = F.col("x")
    old = [F.regexp_replace(x, rf"\A{pattern}+", ""), F.regexp_replace(x, rf"{pattern}+\z", ""), F.regexp_replace(x, rf"\A{pattern}+|{pattern}+\z", "")]
    new = [T.ltrim(x), T.rtrim(x), T.trim(x)]
    assert d.where(~F.array(*old).eqNullSafe(F.array(*new))).count() == 0
    assert times(T.trim(x), "regexp") == 0


def test_slides_are_split_once(spark):
    assert times(noise.title_only(F.col("x")), "split(") == 1
    c = noise.closing(F.col("x"), ("thank you", "q&a"))
    assert times(c, "split(") == 1
    d = spark.createDataFrame([("# T",), ("# T\n\nshort",), ("# T\n" + "x" * 80,), ("a",), ("# THANK\n you",), ("1 2 3 4 5 6 7 thank you",), ("",), (None,)], "x string")
    got = [tuple(r) for r in d.select(noise.title_only(F.col("x")), c).collect()]
    assert got == [(True, False), (True, False), (False, False), (False, False), (True, True), (False, False), (False, False), (None, None)]


def test_terms_stand_between_edges(spark):
    rows = [("the Steps.", True), ("footsteps", False), ("stepsé", True), ("x_steps", False), ("ſTEPS", True), ("(steps)", True), ("step s", False)]
    d = spark.createDataFrame(rows, "x string, want boolean")
    assert d.where(~T.has_term(F.col("x"), F.lit("steps")).eqNullSafe(F.col("want"))).count() == 0
    odd = spark.createDataFrame([("a+b", "a+b", True), ("xa+b", "a+b", False), ("x (c) y", "(c)", False), ("x(c)y", "(c)", True)], "x string, t string, want boolean")
    assert odd.where(~T.has_term(F.col("x"), F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_lists_are_checked_line_by_line(spark):
    assert times(validate.bullets_without_lead(F.col("x")), "split(") == 1
    d = spark.createDataFrame([("# T\nlead:\n- a\n- b",), ("# T\n\n- a",), ("lead:\n\n\n\n- a",), ("**lead:**\n- a\n\nx\n1. y",), ("- a",), ("no list",), ("",)], "x string")
    assert [r[0] for r in d.select(validate.bullets_without_lead(F.col("x"))).collect()] == [False, True, True, True, True, False, False]


def test_locations_of_a_document_together(spark):
    md = "---\n Topic : x\n---\n# A  b\n#  C\n## D\n text E\n####  C\n # F"
    want = {"top": 1, "": 1, "frontmatter.topic": 2, "frontmatter.x": 1, "body": 4, "# A  b": 4, "# C": 5, "## C": 5, "## D": 6, "text E": 7, "# F": 9, "none": 1, " # D ": 6, None: 1}
    d = spark.createDataFrame([(md, list(want))], "m string, at array<string>")
    assert d.select(T.locate_lines(F.col("m"), F.col("at"))).first()[0] == list(want.values())
    assert d.select(F.explode("at").alias("a"), "m").select(T.locate_line(F.col("m"), F.col("a"))).collect() == [(x,) for x in want.values()]
    assert times(T.locate_lines(F.col("m"), F.col("at")), "split(") == 1


def test_edits_are_made_once_in_a_commit(spark):
    """the claims of a commit read the edits more than once, what makes them runs once."""
    from corpusloom.operators import edits

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(0, "# A\n\none"), (1, "# B\n\ntwo"), (2, "# C")], "doc_index long, markdown string")
    rows = [(0, 0, 0, "# A", "# X", 1, 0, "# B", "# Y"), (1, 1, 0, "# B", "# Z", 2, 0, "# C", "# W")]
    schema = "original_order long, a_doc long, a_sec int, a_text string, new_a string, b_doc long, b_sec int, b_text string, new_b string"
    asked = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    _, report = edits.commit(docs, asked)
    assert {r["original_order"]: r["state"] for r in report.collect()} == {0: "done", 1: "claimed"}
    assert made.value == 2


def test_a_term_is_put_in_by_bytes(spark):
    """the results of positions in characters, found without counting characters of the document."""
    from corpusloom.operators import suggest

    md = "# é\n\nöne 😀\n\n# é\n\nöne 😀 tail"
    rows = [(md, "# é\n\nöne 😀", "x"), (md, "# é\n\nöne 😀 tail", "x"), (md, md, "ü"), (md, "gone", "x"), (md, "", "x"), (md, "tail", ""), (md, "tail", "tail"), (None, "a", "x"), (md, None, "x"), ("", "a", "x")]
    d = spark.createDataFrame(rows, "m string, c string, t string")
    got = suggest.apply(d, "m", "c", "t")
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "substring_index" in plan and "position(" not in plan and "locate(" not in plan
    for r in got.collect():
        new = spark.createDataFrame([(r["c"], r["t"])], "c string, t string").select(suggest.insert_term(F.col("c"), F.col("t"))).first()[0]
        done = bool(r["m"] and r["c"]) and new != r["c"] and r["c"] in r["m"]
        assert (r["applied"], r["updated"]) == (done, r["m"].replace(r["c"], new, 1) if done else r["m"])


def test_a_scan_cuts_words_once(spark):
    """the chunks of a search are read for their words and for what is shown, no more."""
    from corpusloom.operators import retrieve

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "doc long, chunk_index long, text string"
    chunks = spark.createDataFrame([(k % 3, k, f"alpha w{k}") for k in range(30)], schema).mapInArrow(count, schema)
    asked = spark.createDataFrame([(1, "alpha w4")], "query_id int, query string")
    got = retrieve.search(chunks, asked, corpus=["doc"], k=2).collect()
    assert sorted((r["doc"], r["rank"], r["chunk_index"]) for r in got) == [(0, 1, 0), (0, 2, 3), (1, 1, 4), (1, 2, 1), (2, 1, 2), (2, 2, 5)]
    assert made.value <= 60


ODD = ["# T\nx y z", "---\na: [1]\n---\n# A\nlead:\n- a\n## B\nshort\n## C\n" + "w " * 90, "", None, "no head\n- a\n\n# C\n\nContact us\n---\n---\n---", "---\ndepartment: x\ntopic: y\ncourse_id: 1\ncourse_name: z\n---\n# Acme\n" + "w " * 80]


def test_issues_are_found_without_a_shuffle(spark):
    """the issues of a document are numbered and its fixes planned in its own row, as fix_plan does."""
    from corpusloom.operators import backends

    d = spark.createDataFrame(list(enumerate(ODD)), "doc_index long, markdown string")
    rows = validate.validate(d, entity="Acme")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    plan = validate.fix_plan(rows)
    lists = validate.issue_lists(d, entity="Acme").select("doc_index", validate.fixes_of(F.col("issues")).alias("f"))
    own = lists.select("doc_index", F.inline("f"))
    assert sorted(plan.select(*own.columns).collect()) == sorted(own.collect()) != []
    assert sorted(backends.render_fixes(plan).collect()) == sorted(lists.where("size(f) > 0").select("doc_index", backends.fix_lines(F.col("f"))).collect())


def test_a_counter_may_be_a_python_udf(spark):
    from corpusloom.functions.text import units

    same = F.pandas_udf(lambda x: x.str.count(r"[^\W_]+|[^\s\w]|_").astype("int32"), "int")
    d = spark.createDataFrame([(k if k else None, x) for k, x in enumerate(ODD)], "doc_index long, markdown string")
    found = [validate.validate(d, entity="Acme", counter=c).collect() for c in (units, same)]
    key = lambda r: (r["doc_index"] or 0, r["ord"])
    assert sorted(found[0], key=key) == sorted(found[1], key=key)


def test_the_model_is_called_once_for_a_document(spark, monkeypatch):
    """the fixed documents are checked and hashed, and made once."""
    from corpusloom.plans import queries

    sent, call = spark.sparkContext.accumulator(0), queries.backends.call

    def counted(rows, prompt, backend, **options):
        def ask(prompts):
            sent.add(len(prompts))
            return backend(prompts)

        return call(rows, prompt, ask, **options)

    monkeypatch.setattr(queries.backends, "call", counted)
    got = queries.fix_apply(spark, "/root/testdata/sf0.001").collect()
    assert sent.value == sum(r["state"] == "model" for r in got) > 0


def test_states_of_fixed_documents(spark):
    from corpusloom.functions.config import FIELDS

    good = "---\ndepartment: x\ntopic: y\ncourse_id: 1\ncourse_name: z\n---\n"
    docs = [good + "# Acme\n" + "w " * 80, "# Acme\n" + "w " * 80, good + "# T", "# T\nfail", None]
    d = validate.issue_lists(spark.createDataFrame(list(enumerate(docs)), "doc_index long, markdown string"), entity="Acme")
    form = dict.fromkeys(FIELDS, F.lit("f"))
    model = lambda rows: rows.withColumn("fixed", F.when(~F.col("asked").contains("fail"), F.concat(F.lit("done "), "fix_list")))
    got = {r["doc_index"]: r for r in validate.fix_documents(d, form, model).collect()}
    assert [got[k]["state"] for k in range(5)] == ["clean", "local", "model", "failed", "local"]
    assert got[0]["markdown"] == docs[0] and got[1]["markdown"].endswith(docs[1]) and got[1]["markdown"].startswith("---\ndepartment: \"f\"")
    assert got[2]["markdown"].startswith("done 1. [merge_short] # T (2 tokens):") and got[3]["markdown"].endswith("# T\nfail")
    form["topic"] = F.lit("")
    assert [validate.fix_documents(d, form, model).where(f"doc_index = {k}").first()["state"] for k in (0, 1, 2)] == ["clean", "form", "model"]
