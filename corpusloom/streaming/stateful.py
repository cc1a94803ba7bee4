"""Streams with state of their own: chat replies decoded chunk by chunk, edits analysed after a pause.

``decode_replies`` keeps, for each reply, the unfinished line, the chunks that came before their turn and
the time at which it counts as silent. Chunks are taken in the order of their numbers, however they are
spread over micro-batches; one that comes twice is ignored. A reply is closed by its ``[DONE]`` or by a
timer; what waited for a chunk that never came is then decoded without it. A closed reply leaves a mark
so that stragglers don't open it anew; a second timer removes the mark, and with processing time all
state also has a time to live. Everything is in Spark's state store: a query that is stopped in the
middle of a line goes on there.

``debounced`` groups edits of a document into sessions that end after a pause; on a stream with a
watermark a session is put out once it can't grow any more, and ``reanalyse`` runs a function over the
documents of each micro-batch, writing under the batch's number, so that a replay replaces its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .sse import feed

STATE = "line string, first boolean, fence boolean, done boolean, next bigint, n bigint, alarm bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE, SILENT = "done", "silent"


class ReplyDecoder(StatefulProcessor):
    """For decode_replies. Times are in milliseconds; ``event`` tells event time from processing time."""

    def __init__(self, silence: int, keep: int, first: int, event: bool) -> None:
        self.silence, self.keep, self.first, self.event = silence, keep, first, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Spark allows a time to live with processing time only; it must outlast late timers.
        life = None if self.event else 2 * (self.silence + self.keep) + 3_600_000
        self.now = handle.getValueState("now", STATE, life)
        self.early = handle.getMapState("early", "seq bigint", "chunk string", life)

    def _state(self) -> list:
        return list(self.now.get()) if self.now.exists() else ["", False, False, False, self.first, 0, None]

    def _take(self, state: list, chunks: list[str]) -> list[tuple]:
        (*state[:4],), deltas = feed(tuple(state[:4]), chunks)
        rows = [(state[5] + k, d, None) for k, d in enumerate(deltas)]
        state[5] += len(deltas)
        return rows

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            columns = {"stream_id": [key[0]] * len(rows), **{c: [r[k] for r in rows] for k, c in enumerate(("n", "delta", "closed"))}}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    def _alarm(self, state: list, at: int) -> None:
        if state[6] is not None:
            self.handle.deleteTimer(state[6])
        state[6] = at
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, came, last = self._state(), {}, None
        for batch in rows:
            for seq, chunk in zip(batch["seq"].tolist(), batch["chunk"].tolist()):
                if seq >= state[4]:
                    came.setdefault(seq, chunk)
            if self.event:
                latest = int(batch["at"].max().timestamp() * 1000)
                last = latest if last is None else max(last, latest)
        if state[3]:
            return
        waiting = {k[0]: v[0] for k, v in self.early.iterator()} if self.early.exists() else {}
        pending, chunks = came | waiting, []
        while state[4] in pending:
            chunks.append(pending.pop(state[4]) or "")
            if state[4] in waiting:
                self.early.removeKey((state[4],))
            state[4] += 1
        for seq in pending.keys() - waiting.keys():
            self.early.updateValue((seq,), (pending[seq],))
        out = self._take(state, chunks)
        base = max(last, (state[6] or 0) - self.silence) if self.event else timerValues.getCurrentProcessingTimeInMs()
        if state[3]:
            out.append((state[5], None, DONE))
            self.early.clear()
            self._alarm(state, base + self.keep)
        else:
            self._alarm(state, base + self.silence)
        self.now.update(tuple(state))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.now.exists():
            return
        state, at = self._state(), expiredTimerInfo.getExpiryTimeInMs()
        if at != state[6]:
            return
        if state[3]:
            self.now.clear()
            return
        waiting = sorted((k[0], v[0]) for k, v in self.early.iterator()) if self.early.exists() else []
        out = self._take(state, [c or "" for _, c in waiting])
        out.append((state[5], None, DONE if state[3] else SILENT))
        self.early.clear()
        state[3], state[6] = True, at + self.keep
        self.handle.registerTimer(state[6])
        self.now.update(tuple(state))
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """The state store that timers and several states of a key need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def decode_replies(chunks: DataFrame, silence_ms: int = 30_000, keep_ms: int = 600_000, first: int = 0, at: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """A streaming table (stream_id, seq, chunk) to (stream_id, n, delta, closed): deltas numbered
    within their reply, and a row without a delta that says how it was closed, ``done`` or ``silent``.
    Chunks are numbered from ``first``. With ``at``, a timestamp column, silence is measured in event
    time behind a watermark of ``delay``, and later rows are dropped; else it is measured on the clock,
    for which Spark goes on running micro-batches: such a query is stopped, it does not end by itself."""
    use_state_store(chunks.sparkSession)
    kind = chunks.select("stream_id").schema[0].dataType.simpleString()
    columns = ["stream_id", F.col("seq").cast("long").alias("seq"), "chunk"]
    rows = chunks.withWatermark(at, delay).select(*columns, F.col(at).alias("at")) if at else chunks.select(*columns)
    decoder = ReplyDecoder(silence_ms, keep_ms, first, bool(at))
    return rows.groupBy("stream_id").transformWithStateInPandas(decoder, f"stream_id {kind}, n bigint, delta string, closed string", "append", "EventTime" if at else "ProcessingTime")


def texts(deltas: DataFrame) -> DataFrame:
    """(stream_id, text, deltas, closed) of what decode_replies has put out, read as a table."""
    parts = F.sort_array(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("n", "delta"))))
    return deltas.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda x: x["delta"]), "").alias("text"), F.count("delta").alias("deltas"), F.max("closed").alias("closed"))


def debounced(edits: DataFrame, key: str, at: str, text: str | None = None, gap: str = "800 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """(key, start, analyse_at, edits[, text]): bursts of edits that end ``gap`` after their last, and the
    text as the last edit left it (ties: the greater text). A stream is watermarked by ``delay``: rows
    that are later are dropped, sessions put out in append mode once the watermark is past their end."""
    rows = edits.withWatermark(at, delay) if edits.isStreaming else edits
    last = [F.max(F.struct(at, text))[text].alias(text)] if text else []
    out = rows.groupBy(key, F.session_window(F.col(at), gap).alias("w")).agg(F.count(F.lit(1)).alias("edits"), *last)
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("analyse_at"), "edits", *([text] if text else []))


def reanalyse(sessions: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that runs ``analyse`` over the sessions of each micro-batch and writes the rows to
    ``out/batch=<number>``."""

    def run(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sessions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def run_through(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what is there to Parquet, in append mode, and stop."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
