"""Repair of conversations whose turns were damaged.

A conversation is read in the order of its turns. Faulty rows are counted (blank, repeated, cut off),
and the cheapest edits are found that make its role initials read ``(s?(ua)+)?``: keep a row, give it
the role that fits, delete it, or insert an empty one. Four states say what was written last (nothing,
system, user, assistant); in each the role that a changed or inserted row gets is fixed, so a string of
edits has one meaning and costs are a table of rows by states.

The tables are time-major NumPy tensors: conversations are bucketed by length, one step updates the
costs to go of all conversations of a bucket, from their last rows to their first, the costs are kept,
and the edits are traced forward, one step for all, each taking the least letter that stays cheapest.

Rows are range-sorted by (conversation, turn, role, start of the text), so a task holds whole
conversations and no conversation has to fit in one. What a task's first and last conversations and
any of more than ``LONG`` rows or ``LONG_BYTES`` hold is passed on in segments: repeats are found by the first place
of a digest, a segment's costs are a four by four matrix worked out apart, matrices are combined from the
last segment to the first, and one pass per conversation traces the segments in turn with the text
digest running along. That pass keeps one segment and the audit, which is the result.

Defined cases: a null role or text is one space; a null conversation id is a conversation; null turns
come first and don't count for gaps; rows of one turn are ordered by role and text; a role that begins
with none of s, u, a can't be kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

#: Rows and bytes of text of the longest conversation that a task solves at once; of a segment of longer ones.
LONG, LONG_BYTES = 4096, 8 << 20
SEGMENT, SEGMENT_BYTES = 1024, 4 << 20
#: Rows and bytes that a task gathers before it solves them.
TOGETHER, TOGETHER_BYTES = 16_384, 16 << 20
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
#: Role initials by code, and of each state (nothing, s, u, a) the state that a kept row of that code leads to.
INITIALS = "?sua"
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: Of each state, the one that a changed or inserted row leads to, and that row's role.
NEXT = np.array([2, 2, 3, 2])
ROLE = ("user", "user", "assistant", "user")
END = np.array([0, NEVER, NEVER, 0])
NONE, BLANK, REPEATED, CUT = range(4)
LEGAL = {(1, 2), (2, 3), (3, 2)}


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs (n, 4) with insertions before what follows; two in a row lead from any state to any other needed."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[:, NEXT])
    return cost


def _backward(code: np.ndarray, fault: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs to go (T + 1, n, 4) of time-major rows; code -1 pads. last (n, 4): costs after the end."""
    t, n = code.shape
    cost = np.empty((t + 1, n, 4), np.int64)
    cost[t] = _closed(last)
    for k in range(t - 1, -1, -1):
        after = cost[k + 1]
        must = ((fault[k] == BLANK) | (fault[k] == REPEATED))[:, None]
        extra = TRUNCATED * (fault[k] == CUT)[:, None]
        to = KEPT[:, np.maximum(code[k], 0)].T
        keep = np.where((to < 0) | must, NEVER, extra + np.take_along_axis(after, np.maximum(to, 0), 1))
        best = np.minimum(np.minimum(DELETE + after, keep), np.where(must, NEVER, RETYPE + extra + after[:, NEXT]))
        cost[k] = np.where((code[k] < 0)[:, None], after, _closed(best))
    return cost


def _trace(code: np.ndarray, fault: np.ndarray, last: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (T + 1, 3, n), 0 for none, of the least cheapest edits from the given states, and the last states."""
    t, n = code.shape
    out, every, state = np.zeros((t + 1, 3, n), np.uint8), np.arange(n), state.copy()
    for k in range(t + 1):
        here, on = cost[k], np.ones(n, bool) if k == t else code[k] >= 0
        if k < t:
            must = (fault[k] == BLANK) | (fault[k] == REPEATED)
            extra = TRUNCATED * (fault[k] == CUT)
        for j in range(3):
            now = here[every, state]
            if k < t:
                after = cost[k + 1]
                gone = on & (DELETE + after[every, state] == now)
                out[k, j, gone] = ord("D")
                on &= ~gone
            else:
                on &= last[every, state] != now
            put = on & (INSERT + here[every, NEXT[state]] == now)
            out[k, j, put] = ord("I")
            if k < t:
                rest = on & ~put
                to = KEPT[state, np.maximum(code[k], 0)]
                kept = rest & ~must & (to >= 0) & (extra + after[every, np.maximum(to, 0)] == now)
                out[k, j, kept] = ord("K")
                out[k, j, rest & ~kept] = ord("R")
                state = np.where(rest, np.where(kept, to, NEXT[state]), state)
                on &= ~rest
            state = np.where(put, NEXT[state], state)
            if not on.any():
                break
    return out, state


def _buckets(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of the conversations whose lengths share a power of two, at most TOGETHER padded rows at once."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    while order:
        most = 1 << max(0, sizes[order[0]] - 1).bit_length()
        n = next((k for k, i in enumerate(order) if sizes[i] > most), len(order))
        n = min(n, max(1, TOGETHER // most))
        yield order[:n]
        order = order[n:]


def _tensors(parts: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """Time-major codes and faults of lists of items (code, fault, ...)."""
    t = max(map(len, parts))
    code, fault = np.full((t, len(parts)), -1, np.int64), np.zeros((t, len(parts)), np.int64)
    for j, items in enumerate(parts):
        if items:
            code[: len(items), j] = [x[0] for x in items]
            fault[: len(items), j] = [x[1] for x in items]
    return code, fault


def matrices(parts: list[list[tuple]]) -> list[np.ndarray]:
    """For each list of items the cheapest cost from each state before it to each state after it."""
    out: list = [None] * len(parts)
    for some in _buckets([len(p) for p in parts]):
        code, fault = _tensors([parts[i] for i in some])
        unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
        cost = _backward(np.repeat(code, 4, axis=1), np.repeat(fault, 4, axis=1), np.tile(unit, (len(some), 1)))[0]
        for j, i in enumerate(some):
            out[i] = np.minimum(cost[4 * j : 4 * j + 4].T, NEVER)
    return out


def solve(parts: list[list[tuple]], last: list[np.ndarray], states: list[int]) -> list[tuple[int, str, int]]:
    """For each list of items, with the costs after it and the state before it: cost, edits, state after."""
    out: list = [None] * len(parts)
    for some in _buckets([len(p) for p in parts]):
        code, fault = _tensors([parts[i] for i in some])
        end, begin = np.array([last[i] for i in some]), np.array([states[i] for i in some])
        cost = _backward(code, fault, end)
        letters, after = _trace(code, fault, end, cost, begin)
        flat = letters.reshape(-1, len(some)).T
        for j, i in enumerate(some):
            out[i] = (int(cost[0, j, begin[j]]), flat[j][flat[j] > 0].tobytes().decode(), int(after[j]))
    return out


class Tally:
    """What is counted of a conversation as its items go by, in order."""

    def __init__(self, with_text: bool) -> None:
        self.faults, self.illegal, self.cost, self.state, self.audit = [0, 0, 0, 0], 0, 0, 0, []
        self.least = self.most = self.code = None
        self.turns, self.sha, self.lines = 0, hashlib.sha256(), 0
        self.texts: list[str] | None = [] if with_text else None

    def seen(self, items: list[tuple]) -> None:
        for code, fault, turn, _, _ in items:
            self.faults[fault] += 1
            if self.code is not None and (self.code, code) not in LEGAL:
                self.illegal += 1
            self.code = code
            if turn is not None and turn != self.most:
                self.least = turn if self.least is None else self.least
                self.most = turn
                self.turns += 1

    def edited(self, items: list[tuple], letters: str) -> None:
        """Write the rows that the edits leave."""
        self.audit.append(letters)
        at, state = 0, self.state
        for x in letters:
            if x == "I":
                self._line(ROLE[state], "")
                state = int(NEXT[state])
                continue
            code, _, _, role, text = items[at]
            at += 1
            if x == "K":
                self._line(role, text)
                state = int(KEPT[state, code])
            elif x == "R":
                self._line(ROLE[state], text)
                state = int(NEXT[state])
        self.state = state

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        if self.texts is not None:
            self.texts.append(f"{role}:{text}")

    def row(self, conv) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        found = (conv, gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())
        return found if self.texts is None else (*found, "\n".join(self.texts))


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FOUND_KINDS = ["long"] * 6 + ["string"] * 2


def _items(rows: list[tuple], repeated: list[bool]) -> list[tuple]:
    """Items (code, fault, turn, role, text) of rows (turn, role, text, code, blank, cut, copies)."""
    out = []
    for (turn, role, text, code, blank, cut, copies), again in zip(rows, repeated):
        for _ in range(copies):
            out.append((code, BLANK if blank else REPEATED if again else CUT if cut else NONE, turn, role, text))
            again = True
    return out


def _repeats(rows: list[tuple]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    out = []
    for _, role, text, *_, copies in rows:
        out.append((role, text) in seen)
        if copies:
            seen.add((role, text))
    return out


def _batch(names: list[str], kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x]) for x, c in zip(names, columns)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        yield list(zip(*(c.to_pylist() for c in batch.columns)))


#: A conversation id that no row has.
_START = object()


def repair(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, with_repaired: bool = False) -> DataFrame:
    """One row for each conversation: FOUND, and on request the repaired text. ``copies`` says how often
    a row stands there; a conversation all of whose rows stand there 0 times is empty."""
    spark = rows.sparkSession
    bounded_batches(spark)
    said, told = F.coalesce(F.col(role).cast("string"), F.lit(" ")), F.coalesce(F.col(text).cast("string"), F.lit(" "))
    code = F.coalesce(*(F.when(said.startswith(x), k) for k, x in enumerate(INITIALS) if k), F.lit(0))
    told_rows = rows.select(
        F.col(id_col).alias("conv"), F.col(turn).cast("long").alias("turn"), said.alias("role"), told.alias("text"),
        code.cast("int").alias("code"),
        (~told.rlike(r"[^\x20\x09-\x0D]")).alias("is_blank"), (~told.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("is_cut"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    names = ["turn", "role", "text", "code", "is_blank", "is_cut", "copies"]
    kind = told_rows.schema["conv"].dataType
    found = ["conv", *FOUND] + ["repaired"] * with_repaired
    found_kinds = [kind.simpleString(), *FOUND_KINDS] + ["string"] * with_repaired
    raw = [*names, "part", "seg", "idx"]
    raw_kinds = ["long", "string", "string", "int", "boolean", "boolean", "int", "long", "long", "long"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations within a task are solved; rows of the others are passed on, numbered."""
        part, done, passed, held = TaskContext.get().partitionId(), [], [], []
        conv, own, size, alone, n = _START, [], 0, True, 0
        seg = in_seg = seg_size = held_rows = held_size = 0

        def pass_on() -> None:
            nonlocal n, seg, in_seg, seg_size, own, size
            for row in own:
                if in_seg >= SEGMENT or seg_size >= SEGMENT_BYTES:
                    seg, in_seg, seg_size = seg + 1, 0, 0
                passed.append((conv, *row, part, seg, n))
                n, in_seg, seg_size = n + 1, in_seg + 1, seg_size + len(row[2])
            own, size = [], 0

        def solved() -> None:
            nonlocal held_rows, held_size
            for (c, items), (cost, letters, _) in zip(held, solve([x[1] for x in held], [END] * len(held), [0] * len(held))):
                t = Tally(with_repaired)
                t.seen(items)
                t.cost = cost
                t.edited(items, letters)
                done.append(t.row(c))
            held.clear()
            held_rows = held_size = 0

        def out() -> Iterator[pa.RecordBatch]:
            empty = (None,) * (len(found) - 1)
            yield _batch(all_names, all_types, [(*x, *(None,) * len(raw)) for x in done] + [(x[0], *empty, *x[1:]) for x in passed])
            done.clear()
            passed.clear()

        for batch in _rows(batches):
            for c, *row in batch:
                if c != conv:
                    if conv is not _START:
                        if alone:
                            pass_on()
                        else:
                            items = _items(own, _repeats(own))
                            held.append((conv, items))
                            held_rows, held_size = held_rows + len(items), held_size + size
                            if held_rows >= TOGETHER or held_size >= TOGETHER_BYTES:
                                solved()
                    alone = conv is _START  # the first may have begun in another task
                    conv, own, size = c, [], 0
                    seg, in_seg, seg_size = seg + 1, 0, 0
                own.append(tuple(row))
                size += len(row[2])
                if alone or len(own) > LONG or size > LONG_BYTES:
                    alone = True
                    pass_on()
            yield from out()
        if conv is not _START:  # the last may go on in another task
            pass_on()
        if held:
            solved()
        yield from out()

    all_names = [*found, *raw]
    schema = ", ".join(f"{x} {k}" for x, k in zip(all_names, [*found_kinds, *raw_kinds]))
    all_types = _arrow(spark, schema)
    ordered = told_rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text", "copies")
    both = materialize(ordered.mapInArrow(first, schema), "turns")
    whole = both.where("audit is not null").select(*found)
    cut = both.where("audit is null").select("conv", *raw)
    return whole.unionByName(_over_tasks(cut, found, found_kinds, with_repaired)).withColumnRenamed("conv", id_col)


def _arrow(spark, schema: str) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in spark.createDataFrame([], schema).schema}


def _over_tasks(cut: DataFrame, found: list[str], found_kinds: list[str], with_repaired: bool) -> DataFrame:
    """Results of conversations whose rows several tasks hold, or that are too long for one step."""
    spark = cut.sparkSession
    place = F.struct("part", "idx")
    keyed = cut.where("copies > 0").select("conv", "part", "seg", "idx", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"))
    firsts = keyed.groupBy(F.col("conv").alias("of"), F.col("digest").alias("same")).agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1")
    again = keyed.join(firsts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))).where(place > F.col("at")).select("conv", "part", "seg", "idx")
    again = materialize(again, "repeated-turns")

    # The marks of repeated rows come just before those rows.
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    order = ["conv", "part", "seg", "idx", "mark"]

    def padded(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[F.col(x) if x in have else F.lit(None).cast(k).alias(x) for x, k in {**kinds, "exits": "array<bigint>"}.items()], "mark")

    marks, events = padded(again.withColumn("mark", F.lit(1))), padded(cut.withColumn("mark", F.lit(2)))
    features = events.withColumn("text", F.lit("")).withColumn("role", F.lit(""))
    columns = ["conv", "part", "seg", "idx", "mark", "turn", "role", "text", "code", "is_blank", "is_cut", "copies", "exits"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv, part, seg, rows, repeated, exits) of each segment of sorted events."""
        key, rows, repeated, exits, marked = _START, [], [], None, False
        for batch in _rows(batches):
            for conv, part, seg, _, mark, *row, out in batch:
                if (conv, part, seg) != key:
                    if key is not _START:
                        yield *key, rows, repeated, exits
                    key, rows, repeated, exits, marked = (conv, part, seg), [], [], None, False
                if mark == 0:
                    exits = out
                elif mark == 1:
                    marked = True
                else:
                    rows.append(tuple(row))
                    repeated.append(marked)
                    marked = False
        if key is not _START:
            yield *key, rows, repeated, exits

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0

        def out() -> pa.RecordBatch:
            return _batch(["conv", "part", "seg", "costs"], cost_types, [(*k, m.ravel().tolist()) for (k, _), m in zip(some, matrices([x[1] for x in some]))])

        for *key, rows, repeated, _ in segments(batches):
            some.append((key, items := _items(rows, repeated)))
            n += len(items)
            if n >= TOGETHER:
                yield out()
                some, n = [], 0
        if some:
            yield out()

    cost_schema = f"conv {kinds['conv']}, part long, seg long, costs array<bigint>"
    cost_types = _arrow(spark, cost_schema)
    sums = features.unionByName(marks).select(*columns).repartition("conv", "part", "seg").sortWithinPartitions(*order).mapInArrow(costs, cost_schema)

    def combined(key: tuple, rows: pa.Table) -> pa.Table:
        """Costs after each segment of a conversation."""
        rows = rows.sort_by([("part", "ascending"), ("seg", "ascending")])
        after, out = END, []
        for one in reversed(rows.column("costs").to_pylist()):
            out.append(after.tolist())
            after = np.minimum((np.array(one).reshape(4, 4) + after[None, :]).min(axis=1), NEVER)
        return pa.table({"conv": rows.column("conv"), "part": rows.column("part"), "seg": rows.column("seg"), "exits": pa.array(out[::-1], pa.list_(pa.int64()))})

    exits = sums.groupBy("conv").applyInArrow(combined, f"conv {kinds['conv']}, part long, seg long, exits array<bigint>")
    exits = padded(exits.select("*", F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("mark")))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a conversation one after the other: the edits go on from the state before."""
        conv, t, done = _START, None, []
        for c, _, _, rows, repeated, out in segments(batches):
            if c != conv:
                if t:
                    done.append(t.row(conv))
                if len(done) >= 1024:
                    yield _batch(found, found_types, done)
                    done = []
                conv, t, begins = c, Tally(with_repaired), True
            items = _items(rows, repeated)
            t.seen(items)
            ((cost, letters, _),) = solve([items], [np.array(out)], [t.state])
            if begins:
                t.cost, begins = cost, False
            t.edited(items, letters)
        if t:
            done.append(t.row(conv))
        yield _batch(found, found_types, done)

    found_schema = ", ".join(f"{x} {k}" for x, k in zip(found, found_kinds))
    found_types = _arrow(spark, found_schema)
    return events.unionByName(marks).unionByName(exits).select(*columns).repartition("conv").sortWithinPartitions(*order).mapInArrow(last, found_schema)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations damaged by the checksum of (conversation, turn), and how often each row then stands there."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    by = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    out = rows.select(
        "conv_id", "turn", F.when(by == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(by <= 1, F.lit("")).when(by == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(by == 0, 0).when(by == 3, 2).otherwise(1).alias("copies"),
    )
    return out, F.col("copies")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, copies=copies)
