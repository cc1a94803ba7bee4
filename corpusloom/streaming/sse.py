"""Server-sent events: text deltas of a chat stream, in batch and as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PATH = "$.choices[0].delta.content"


def strip_opening_fence(text: Column) -> Column:
    """Without a fence that opens the text, up to its newline; nothing if that has not come."""
    return F.when(text.startswith("```"), F.when(F.locate("\n", text) > 0, F.substr(text, F.locate("\n", text) + 1)).otherwise(F.lit(""))).otherwise(text)


def decode(chunks: DataFrame) -> DataFrame:
    """chunks: (stream_id, seq, chunk). (stream_id, text, deltas): whole lines of ``data:`` up to
    ``[DONE]``; what is no JSON is skipped, an unfinished last line dropped. A stream is one
    reply, bounded by its model's limit."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "chunk")))
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("raw"))
    lines = F.slice(F.split("raw", "\n"), F.lit(1), F.size(F.split("raw", "\n")) - 1)
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    out = whole.withColumn("data", data)
    done = F.array_position("data", "[DONE]")
    out = out.withColumn("data", F.when(done > 0, F.slice("data", F.lit(1), (done - 1).cast("int"))).otherwise(F.col("data")))
    out = out.withColumn("d", F.filter(F.transform("data", lambda x: F.get_json_object(x, PATH)), lambda x: x.isNotNull() & (x != "")))
    return out.select("stream_id", strip_opening_fence(F.array_join("d", "")).alias("text"), F.size("d").alias("deltas"))


def running_text(deltas: DataFrame) -> DataFrame:
    """deltas: (stream_id, seq, delta). Adds the text so far after each delta."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("text", F.array_join(F.collect_list("delta").over(w), ""))


def idle_sessions(edits: DataFrame, key: str, at: str, gap: str = "800 milliseconds") -> DataFrame:
    """Bursts of edits that end after an idle gap: when each document is analysed again. Works on
    a stream with a watermark as on a table."""
    w = F.session_window(F.col(at), gap)
    return edits.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("edits")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("analyse_at"), "edits")


STATE = "line string, first boolean, fence boolean, done boolean"
OUTPUT = "stream_id string, delta string"


def feed(state: tuple, chunks: list[str]) -> tuple[tuple, list[str]]:
    """The state after chunks, and the deltas they give."""
    line, first, fence, done = state
    out = []
    for chunk in chunks:
        *whole, line = (line + chunk).split("\n")
        for one in whole:
            if done or not one.startswith("data:"):
                continue
            data = one[5:].strip()
            if data == "[DONE]":
                done = True
                continue
            try:
                delta = json.loads(data)["choices"][0]["delta"].get("content")
            except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                continue
            if not delta:
                continue
            if not first:
                first, fence = True, delta.startswith("```")
            if fence:
                head, found, rest = delta.partition("\n")
                if not found:
                    continue
                fence, delta = False, rest
            if delta:
                out.append(delta)
    return (line, first, fence, done), out


def decode_stream(chunks: DataFrame) -> DataFrame:
    """A streaming table (stream_id, seq, chunk) to its deltas, with state for each stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("", False, False, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        now, out = feed(tuple(now), rows["chunk"].tolist())
        state.update(now)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "delta": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
