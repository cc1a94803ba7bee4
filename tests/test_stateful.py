"""Stateful streams: restarts in the middle of a line, silence, order, duplicates; sessions with late rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import sse, stateful

T0 = dt.datetime(2024, 1, 1)
CHUNKS = "stream_id string, seq long, chunk string, at timestamp"


def event(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]}, ensure_ascii=False) + "\n"


def pieces(raw, *cuts):
    return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]


class Feed:
    """A folder that a stream reads; each run takes what came since the last one."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, make):
        stateful.run_through(make(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")), f"{self.path}/out", f"{self.path}/checkpoint")
        return self.spark.read.parquet(f"{self.path}/out")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def decoded(chunks):
    return stateful.decode_replies(chunks, silence_ms=20_000, keep_ms=50_000, at="at", delay="1 second")


def test_restart_in_mid_line_equals_the_batch(spark, tmp_path):
    """Three runs of a query over one checkpoint; chunks out of order, doubled, and after a close."""
    a = pieces(event("```md\nHé") + event("llo") + ": note\n\ndata: oops\n" + event(" world") + "data: [DONE]\n", 7, 30, 95, 130)
    b = pieces(event("one ") + event("two") + "data: {unfinished", 50, 60)
    c = [event("x"), event("y"), event("z")]  # its second chunk never comes
    f = Feed(spark, tmp_path, CHUNKS)
    f.put([("a", 2, a[2], at(2)), ("a", 0, a[0], at(0)), ("b", 0, b[0], at(1)), ("c", 2, c[2], at(3))])
    first = f.run(decoded).collect()
    f.put([("a", 1, a[1], at(4)), ("a", 1, a[1], at(4)), ("b", 1, b[1], at(5)), ("c", 0, c[0], at(5))])
    f.run(decoded)
    f.put([("a", 0, a[0], at(6)), ("b", 2, b[2], at(6)), ("a", 4, a[4], at(6)), ("a", 3, a[3], at(6))])
    f.run(decoded)
    f.put([("d", 0, event("late"), at(40))])  # the watermark passes the silence of b and c
    f.run(decoded)
    f.put([("b", 3, event("straggler"), at(41))])
    rows = f.run(decoded)
    got = {r["stream_id"]: (r["text"], r["deltas"], r["closed"]) for r in stateful.texts(rows).collect()}
    whole = spark.createDataFrame([(k, i, x) for k, v in (("a", a), ("b", b)) for i, x in enumerate(v)], "stream_id string, seq int, chunk string")
    want = {r["stream_id"]: (r["text"], r["deltas"]) for r in sse.decode(whole).collect()}
    assert {k: got[k][:2] for k in "ab"} == want and want["a"] == ("Héllo world", 3)
    assert [got[k][2] for k in "abc"] == ["done", "silent", "silent"]
    assert got["c"][0] == "xz" and got["d"] == ("late", 1, None)
    assert "c" not in {r["stream_id"] for r in first}
    ns = [(r["stream_id"], r["n"]) for r in rows.collect()]
    assert len(ns) == len(set(ns))


def test_clock_timers_close_a_silent_reply(spark, tmp_path):
    f = Feed(spark, tmp_path, "stream_id long, seq int, chunk string")
    f.put([(2**60 + 1, 0, event("a") + "data: {half")])
    chunks = spark.readStream.schema(f.schema).parquet(f"{f.path}/in")
    q = stateful.decode_replies(chunks, silence_ms=1000, keep_ms=500).writeStream.format("parquet").option("checkpointLocation", f"{f.path}/checkpoint").outputMode("append").trigger(processingTime="1 second").start(f"{f.path}/out")
    try:
        for _ in range(60):
            q.awaitTermination(1)
            got = {tuple(r) for r in spark.read.schema("stream_id long, n long, delta string, closed string").parquet(f"{f.path}/out").collect()}
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert got == {(2**60 + 1, 0, "a", None), (2**60 + 1, 1, None, "silent")}


EDITS = "doc long, at timestamp, markdown string"


def test_sessions_with_late_and_unordered_rows(spark, tmp_path):
    """Equal to the batch over all rows but the one that comes after the watermark."""
    make = lambda x: stateful.debounced(x, "doc", "at", "markdown", gap="5 seconds", delay="10 seconds")
    f = Feed(spark, tmp_path, EDITS)
    kept = [(1, at(3), "c"), (1, at(0), "a"), (1, at(1), "b"), (2, at(2), "x")]
    f.put(kept)
    assert f.run(make).count() == 0  # nothing can be closed yet
    more = [(1, at(12), "e"), (1, at(7), "d"), (2, at(30), "far")]  # 7 joins 3 and 12: late, but within the watermark
    f.put(more)
    f.run(make)
    f.put([(1, at(15), "too late"), (3, at(100), "end")])
    rows = f.run(make).collect()
    batch = make(spark.createDataFrame(kept + more + [(3, at(100), "end")], EDITS)).where(F.col("analyse_at") <= F.lit(at(90)))
    assert sorted(rows) == sorted(batch.collect())
    assert {(r["doc"], r["edits"], r["markdown"]) for r in rows} == {(1, 5, "e"), (2, 1, "x"), (2, 1, "far")}


def test_reanalysis_of_each_batch_is_replaced_by_a_replay(spark, tmp_path):
    f = Feed(spark, tmp_path, EDITS)
    f.put([(1, at(0), "# A"), (1, at(1), "# B"), (2, at(60), "# C")])
    source = spark.readStream.schema(EDITS).parquet(f"{f.path}/in")
    analyse = lambda x: x.select("doc", F.regexp_extract("markdown", r"# (\w+)", 1).alias("heading"))
    sessions = stateful.debounced(source, "doc", "at", "markdown", gap="5 seconds", delay="1 second")
    for k in range(2):  # the second checkpoint knows nothing: all batches run again
        stateful.reanalyse(sessions, analyse, f"{f.path}/analysed", f"{f.path}/again{k}").awaitTermination()
    assert [(r["doc"], r["heading"]) for r in spark.read.parquet(f"{f.path}/analysed").collect()] == [(1, "B")]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
