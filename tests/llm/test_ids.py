"""Ids beyond 2**53 stay themselves beside null ids, in every stage that carries them through Python."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, langid, packing, pii, simhash, toxicity, warc

A, B = 2**60 + 1, 2**60 + 3


@pytest.fixture(scope="module")
def docs(spark):
    text = "the quick brown fox jumps over the lazy dog and mails a@b.org for more of it "
    rows = [(A, text * 20, "en"), (None, "null id", "en"), (B, text * 20, "en"), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).distinct().collect()), key=lambda x: (x is not None, x))


def test_ids_of_documents(docs, spark):
    want = [None, 5, A, B]
    assert ids(pii.detect(docs)) == want
    assert ids(simhash.fingerprints(docs)) == want
    assert ids(packing.pack(docs)) == want
    assert ids(langid.predict(docs, langid.fit(docs))) == want
    labels = spark.createDataFrame([(A, 1), (B, 0)], "doc_id long, toxic int")
    assert ids(toxicity.predict(docs, toxicity.fit(docs, labels))) == want
    assert ids(bpe.encode(docs)) == want


def test_component_is_an_id_of_a_document(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"]}
    assert got[A] == got[B] == A


@pytest.mark.parametrize("with_null", [True, False])
def test_revisits_refer_to_the_page_with_the_payload(docs, with_null):
    """A page without a twin has no response to refer to: that column always holds nulls."""
    pages = docs.where("doc_id > 5 or doc_id is null" if with_null else "doc_id > 5").select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {B: ("response", None), A: ("revisit", B)} | ({None: ("response", None)} if with_null else {})


def test_packing_refuses_tokenizers_that_it_would_misread():
    import public_tokenizers

    with pytest.raises(ValueError, match="word ends"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_powers_of_long_words_are_not_kept():
    import numpy as np

    from corpusloom.llm import tokens

    for n in (70_000, 80_000):
        tokens.words(np.frombuffer(b"x" * n, np.uint8), np.array([0, n]))
    assert tokens._powers.cache_info().currsize <= 1
