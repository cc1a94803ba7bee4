"""Corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
its result is written as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import linededup, mixing, packing, quality, simhash
from corpusloom.llm.common import materialize, table

#: Nine tenths of the tokens there are, dealt by the square root of what a branch holds: branches
#: above their share are cut to it. A branch may be taken once, so a document at most once.
MIX = mixing.Mix(tokens=0.9, power=0.5, epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits are cut from the others."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match earlier ones are cut; every document stays."""
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return simhash.without_near_copies(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that their branch's budget of tokens reaches stay; see MIX. A null source is the branch '', a null
    text has no tokens; rows that repeat a doc_id count each, ties go by text; an empty table gives no rows."""
    return mixing.mixed(docs, MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. A null or empty text is its end mark alone; rows that repeat a doc_id are packed
    each; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_to_weights),
    ("packing", pack_sequences),
]

#: Near dedup, packing and the token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
