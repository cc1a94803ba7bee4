"""Model calls, object stores and token counts at their edges."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusloom.functions.tokens import bpe_counter
from corpusloom.operators import backends
from corpusloom.plans.queries import ENTITY
from corpusloom.operators import validate
from corpusloom.sources.jobs import FolderStore


def test_call_keeps_ids_and_counts_failures(spark):
    """Ids beyond 2**53 beside nulls; the batches of one partition in three fail for good."""
    rows = [(2**60 + k if k % 5 else None, k, f"prompt {k}" if k != 7 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, k int, prompt string").repartition(3, "k").withColumn("part", F.spark_partition_id())

    def backend(prompts):
        if any(p == "prompt 11" for p in prompts):
            raise OSError("down")
        return [None if p is None else p.upper() for p in prompts]

    counter = Observation("judge")
    got = backends.call(df, "prompt", backend, counter=counter).collect()
    assert sorted((r["id"] or 0, r["k"]) for r in got) == sorted((i or 0, k) for i, k, _ in rows)
    bad = next(r["part"] for r in got if r["k"] == 11)
    assert all((r["reply"] is None) == (r["part"] == bad or r["k"] == 7) for r in got)
    assert counter.get == {"called": 59, "failed": sum(r["part"] == bad and r["k"] != 7 for r in got)}


def test_a_batch_is_tried_again(spark, tmp_path):
    mark = str(tmp_path / "tried")

    def backend(prompts):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("once")
        return prompts

    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    assert {r["reply"] for r in backends.call(df, "prompt", backend).collect()} == {"a", "b"}


def test_rows_without_a_prompt_are_not_sent(spark):
    """a backend that takes its prompts as texts gets texts only, and must answer each."""
    df = spark.createDataFrame([(k, None if k % 3 == 0 else f"p{k}") for k in range(7)], "k int, prompt string").coalesce(1)
    got = backends.call(df, "prompt", lambda prompts: [x + f"/{len(prompts)}" for x in prompts]).collect()
    assert {r["k"]: r["reply"] for r in got} == {k: None if k % 3 == 0 else f"p{k}/4" for k in range(7)}
    assert backends.call(df.where("prompt is null"), "prompt", lambda prompts: 1 / 0).where("reply is not null").count() == 0
    with pytest.raises(Exception, match="1 replies to 4 prompts"):
        backends.call(df, "prompt", lambda prompts: prompts[:1]).collect()


def test_folder_store(tmp_path):
    store = FolderStore(f"file://{tmp_path}")
    store.put("uploads/a/b.pdf", b"\x00\xff data")
    store.put("uploads/a/b.pdf", b"newer")
    store.put("uploads/c", b"")
    assert store.get("uploads/a/b.pdf") == b"newer" and store.get("uploads/c") == b""
    store.delete("uploads/c")
    for act in (store.get, store.delete):
        with pytest.raises(FileNotFoundError):
            act("uploads/c")


def test_sub_word_counts_equal_the_plain_merge(spark):
    """Counts against merging the ranks by hand."""
    import base64

    import public_tokenizers as P
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}

    def brute(text):
        n = 0
        for piece in regex.findall(P.PATTERN, text):
            parts = [bytes([b]) for b in piece.encode()]
            while True:
                best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if best is None:
                    break
                k = best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            n += len(parts)
        return n

    r = random.Random(5)
    texts = ["", "Hello world", "# Heading\n\n- item 10%", "日本語 é ß \U0001f600", "<|endoftext|>", " \n\t ", *("".join(r.choice("abc eé.,\n19'日") for _ in range(60)) for _ in range(40))]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", bpe_counter()(F.col("t")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {k: brute(t) for k, t in enumerate(texts)}


def test_contact_is_asked_for_where_there_is_none(spark):
    docs = [(1, "# A\n\nPlease contact us."), (2, "# A\n\nContact me at a@b.org"), (3, "# A\n\ncontact us: +62 21 555 0100"), (4, "# A\n\ncontacted us"), (5, "# A\n\nContact\nus")]
    df = spark.createDataFrame(docs, "doc_index int, markdown string")
    found = validate.validate(df, entity=ENTITY).where("check = 'explicit_contact'")
    assert {r["doc_index"] for r in found.collect()} == {1, 5}
