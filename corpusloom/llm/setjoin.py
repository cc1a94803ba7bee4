"""Exact self-join of the sets of a corpus by Jaccard similarity.

Equal sets are one node; nodes are numbered in the order of their first places, (doc_id, hash of
the text, line), so the smaller number is the earlier one. Tokens of a node go by rarity, and two
nodes of similarity ``s`` or more share a token of their prefixes. Only the prefixes are shuffled:
in the group of a token a window over sizes (the length filter), the positional filter and a bound
from parity bits leave the candidates.

What has to be found is less than all pairs: for each node one earlier node that it matches
(``earlier``), or the components over all matches (``connect``), or both. A pair is *needed* until
the later node has its match, or until both ends lie in one component. The first round takes of
each node and token the earliest candidate; later rounds take eight and at last all candidates that
are still needed, from the nodes that have candidates at all and under a wider bound from parity. So a
group of copies gives rows in proportion to its size times its number of chunks (below), and no link
is lost. Every pair taken is verified on the whole sets. The pairs that are not needed can be counted
afterwards: each lies within one component, where ``matched`` compares the whole sets.

Rarity comes from a table of fixed size: counts of tokens over all texts in ``2**CELLS`` cells.
Any order gives the same result; cells shared by words cost time only. A token whose group would be
larger than ``CHUNK`` is cut into chunks, and every pair of chunks is a group: a token of n nodes has
(n / CHUNK)**2 / 2 groups, dealt over all tasks. Prefix rows are shuffled packed, many to a value, while
common tokens are few enough to be sent to every worker; else each is a row. The result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import Scratch, counted
from .components import connected_components

CHUNK = 2048
#: Candidates of a node and token by round.
ROUNDS = (1, 8, None)
#: Blocks of the table of counts, each summed by one task.
BLOCKS = 256
COUNT = [("n", np.dtype(np.int64), 1)]
#: Common tokens that every worker may hold.
SMALL = 100_000
#: Nodes with candidates up to which their numbers, 8 bytes each, are broadcast.
MET = 1_000_000
#: Members of a component that are compared with as many others at a time.
PIECE = 512
#: Long words of the filter that says which sets are fetched: 32 MB at most.
FILTER = 1 << 22

#: Of texts, and optionally of which sets (see ``tokens``), row, line and number of each token.
Splitter = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def rarity(texts: DataFrame, split: Splitter) -> np.ndarray:
    """Rarity class of each cell, from the tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << tk.CELLS, np.int64)
        for batch in batches:
            total += np.bincount(tk.cell(split(batch.column(0))[2]), minlength=len(total))
        yield packed_counts({k: x for k, x in enumerate(total.reshape(BLOCKS, -1)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + _unplaned(blob, (1 << tk.CELLS) // BLOCKS, COUNT)["n"]
        yield packed_counts(sums)

    def packed_counts(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([_planes(x, np.dtype(np.int64), 1) for x in counts.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = texts.mapInArrow(run, schema).repartitionById(min(n, BLOCKS), "block").mapInArrow(add, schema).toArrow()
    out = np.zeros((BLOCKS, (1 << tk.CELLS) // BLOCKS), np.int64)
    for k, blob in zip(found["block"].to_pylist(), found["counts"].to_pylist()):
        out[k] = _unplaned(blob, out.shape[1], COUNT)["n"]
    out = out.ravel()
    return tk.classes(out)


@dataclass
class Found:
    """``places``: (node, doc_id, text_key, line), one row for each set of each text. ``heads``:
    (nid, node, doc_id, text_key, line, size, bits, bits2, print, prefix, common, copies), one row for each
    node. ``scratch`` holds what was written on the way. ``sets``: what ``fetch`` gives for all nodes that
    have candidates, once ``joined`` has run."""

    rows: DataFrame
    split: Splitter
    similarity: float
    classes: object
    places: DataFrame
    heads: DataFrame
    scratch: Scratch
    sets: DataFrame | None = None


def units(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(text, doc_id, text_key) of the rows with a doc_id. Rows equal in both are one document."""
    rows = docs.select(F.col(text).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.select("text", "doc_id", F.xxhash64("text").alias("text_key")).where("doc_id is not null")


def find(docs: DataFrame, split: Splitter, similarity: float, id_col: str = "doc_id", text: str = "text", prints: bool = False) -> Found:
    """The nodes of docs. With ``prints`` a node has a SimHash fingerprint, else zero."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = units(docs, id_col, text)
    classes = spark.sparkContext.broadcast(rarity(rows.select("text"), split))
    hot = int(2 * np.log2(CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = tk.Sets(*split(batch.column(0)), classes.value)
            if not len(sets):
                continue
            node, doc, key = sets.node(), batch.column(1).to_numpy(zero_copy_only=False)[sets.row], batch.column(2).to_numpy(zero_copy_only=False)[sets.row]
            # Of equal sets in the batch, only the first brings its prefix.
            by = np.lexsort((sets.line, key, doc, node))
            head = np.zeros(len(sets), bool)
            head[by[np.r_[True, node[by][1:] != node[by][:-1]]]] = True
            most = np.where(head, sets.prefix_size(similarity), 0)
            prefix, offsets = sets.take(np.arange(len(sets)), most)
            # Tokens that may be common, the last of a prefix: their cells hold enough words.
            common = np.diff(np.r_[0, np.cumsum((prefix >> np.uint64(tk.CODE)).astype(np.int64) >= hot)][offsets])
            columns = [node, doc, key, sets.line.astype(np.int32), sets.size.astype(np.int32), *sets.bits(), sets.fingerprint() if prints else np.zeros(len(sets), np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), tk.binary(tk.short(prefix), offsets, head), pa.array(common.astype(np.int32))], names)

    schema = "node long, doc_id long, text_key long, line int, size int, bits long, bits2 long, print long, prefix binary, common int"
    names = [x.split()[0] for x in schema.split(", ")]
    seen = scratch.write(rows.mapInArrow(run, schema), "wide-places")
    place = F.struct("doc_id", "text_key", "line")
    first = seen.groupBy("node").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.max("bits").alias("bits"), F.max("bits2").alias("bits2"), F.max("print").alias("print"), F.max("prefix").alias("prefix"), F.max("common").alias("common"))
    first = first.select("node", "f.*", "size", "bits", "bits2", "print", "prefix", "common", "copies")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    heads = first.repartitionByRange(n, "doc_id", "text_key", "line").sortWithinPartitions("doc_id", "text_key", "line")
    heads = scratch.write(heads.select(F.monotonically_increasing_id().alias("nid"), "*"), "set-nodes")
    places = scratch.write(seen.select("node", "doc_id", "text_key", "line"), "set-places")
    scratch.forget("wide-places")
    return Found(rows, split, similarity, classes, places, heads, scratch)


def prefix_rows(heads: DataFrame, more: tuple[str, ...] = (), only_common: bool = False) -> DataFrame:
    """heads: nid, size, bits, bits2, prefix, common and the columns ``more``. (token, size, nid,
    position, bits, bits2, and more), one row for each token of a prefix."""
    names = ["token", "size", "nid", "position", "bits", "bits2", *more]
    schema = ", ".join(["token int, size int, nid long, position int, bits long, bits2 long", *[f"{c} {heads.schema[c].dataType.simpleString()}" for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, offsets = tk.unpacked(batch.column("prefix"), np.int32)
            n = np.diff(offsets)
            at = np.repeat(np.arange(len(n)), n)
            position = np.arange(len(at)) - offsets[:-1][at]
            if only_common:
                keep = position >= (n - batch.column("common").to_numpy(zero_copy_only=False))[at]
                at, position, token = at[keep], position[keep], token[keep]
            which = pa.array(at)
            columns = {c: batch.column(c).take(which) for c in ("size", "nid", "bits", "bits2", *more)} | {"token": pa.array(token), "position": pa.array(position.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return heads.select("nid", "size", "bits", "bits2", "prefix", "common", *more).mapInArrow(run, schema)


def common_tokens(scratch: Scratch, heads: DataFrame) -> tuple[DataFrame | None, bool]:
    """(token, c) for tokens whose groups are to be cut into c chunks, None if there are none; and
    whether they are few enough to be sent to every worker."""
    hot = prefix_rows(heads.where("common > 0"), only_common=True).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    hot = scratch.write(hot.select("token", F.ceil(F.col("n") / CHUNK).cast("int").alias("c")), "common-tokens")
    number = hot.count()
    return (hot if number else None), number <= SMALL


def dealt(heads: DataFrame, hot: DataFrame | None, more: tuple[str, ...] = ()) -> DataFrame:
    """Prefix rows, a group together and by size within: ``key`` is the group, then the size. A group
    is a token, or a pair of chunks of a common token; groups that a hash puts together cost
    comparisons, no result."""
    n = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = prefix_rows(heads, more)
    if hot is not None:
        met = rows.join(hot, "token", "left").withColumn("c", F.coalesce("c", F.lit(1)))
        met = met.withColumn("mine", F.pmod(F.xxhash64("nid"), "c").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        rows = met.withColumn("token", F.when(F.col("c") == 1, F.col("token")).otherwise(F.hash("token", F.least("mine", "other"), F.greatest("mine", "other"))))
    key = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(F.col("size").cast("long"))
    return rows.select(key.alias("key"), "nid", "position", "bits", "bits2", *more).repartition(n, F.shiftright("key", 32)).sortWithinPartitions("key")


def candidates(rows: dict[str, np.ndarray], similarity: float, most: int | None, earlier: bool, connect: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows: whole groups, by key; root, open and sketch may be absent. (later, earlier, more):
    needed pairs that pass the filters, of each later row the earliest (``most`` 1), ``most``, or
    all; a row with candidates but none that is earlier and taken has the pair with -1. more: the
    row has candidates not given. Pairs that pass but are not needed are left to ``matched``."""
    key, nid, position = rows["key"], rows["nid"], rows["position"].astype(np.int64)
    bits, bits2 = rows["bits"].view(np.uint64), rows["bits2"].view(np.uint64)
    size = key & np.int64(0xFFFFFFFF)
    root, open_, sketch = rows.get("root"), rows.get("open"), rows.get("sketch")
    n = len(nid)
    # Where the group's sizes exceed what the row may match.
    end = np.searchsorted(key, (key - size) | np.floor(np.round(size / similarity, 6)).astype(np.int64), "right")
    best, got, seen, out = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, bool), []
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        b = at + d
        s, t = size[at], size[b]
        need = tk.ceil(similarity / (1 + similarity) * (s + t))
        ok = (s + t - np.bitwise_count(bits[at] ^ bits[b]).astype(np.int64) - np.bitwise_count(bits2[at] ^ bits2[b])) // 2 >= need
        a, b, s, t, need = at[ok], b[ok], s[ok], t[ok], need[ok]
        ok = (np.minimum(s - position[a], t - position[b]) >= need) & (nid[a] != nid[b])
        a, b, s, t, need = a[ok], b[ok], s[ok], t[ok], need[ok]
        if sketch is not None and len(a):
            ok = (s + t - np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)) // 2 >= need
            a, b = a[ok], b[ok]
        if len(a):
            turned = nid[a] > nid[b]
            late, soon = np.where(turned, a, b), np.where(turned, b, a)
            ok = np.zeros(len(a), bool)
            if earlier:
                ok |= open_[late] if open_ is not None else True
            if connect:
                ok |= root[a] != root[b] if root is not None else True
            late, soon, turned = late[ok], soon[ok], turned[ok]
            seen[late] = seen[soon] = True
            # A row is late at most once as the left and once as the right one.
            for side in (turned, ~turned):
                x, y = late[side], soon[side]
                if most == 1:
                    best[x] = np.minimum(best[x], nid[y])
                elif most is not None:
                    room = got[x] < most
                    out.append((nid[x[room]], nid[y[room]]))
                else:
                    out.append((nid[x], nid[y]))
                got[x] += 1
        d += 1
    if most == 1:
        hit = np.flatnonzero(seen)
        return nid[hit], np.where(got[hit] > 0, best[hit], -1), got[hit] > 1
    later, soon = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    more = np.flatnonzero(got > most) if most is not None else np.zeros(0, np.int64)
    return np.r_[later, nid[more]], np.r_[soon, np.full(len(more), -1)], np.r_[np.zeros(len(later), bool), np.ones(len(more), bool)]


#: Rows of a prefix that one task takes at most, but for one group, and those compared together.
ROWS, PART = 2_000_000, 1 << 16


def _columns(more: tuple[str, ...]) -> list[tuple[str, np.dtype, int]]:
    """(name, type, numbers a row) of the columns of a packed row."""
    kind = {"root": (np.int64, 1), "open": (bool, 1), "sketch": (np.uint64, tk.SKETCH)}
    plain = [("token", np.int32), ("size", np.int32), ("nid", np.int64), ("position", np.int32), ("bits", np.int64), ("bits2", np.int64)]
    return [*[(c, np.dtype(t), 1) for c, t in plain], *[(c, np.dtype(kind[c][0]), kind[c][1]) for c in more]]


def packed(heads: DataFrame, hot: DataFrame | None, more: tuple[str, ...] = ()) -> DataFrame:
    """Prefix rows as ``dealt`` gives them, (part, n, rows): those of one batch that go to one task
    are one value, column by column and byte by byte, so that no row passes the JVM by itself.
    ``hot`` is small enough to be sent to every worker."""
    spark = heads.sparkSession
    columns = _columns(more)
    large = hot.toArrow().sort_by("token") if hot is not None else None
    common = spark.sparkContext.broadcast((large["token"].to_numpy(), large["c"].to_numpy().astype(np.int64)) if large is not None else None)
    total = heads.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    total = total // 4 + (int((common.value[1] ** 2).sum()) * CHUNK if large is not None else 0)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-total // ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, offsets = tk.unpacked(batch.column("prefix"), np.int32)
            at = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            position = (np.arange(len(at)) - offsets[:-1][at]).astype(np.int32)
            if common.value is not None and len(at):
                known, times = common.value
                place = np.minimum(np.searchsorted(known, token), len(known) - 1)
                c = np.where(known[place] == token, times[place], 1)
                mine = (tk.mix(batch.column("nid").to_numpy().view(np.uint64))[at] % c.astype(np.uint64)).astype(np.int64)
                copy = np.repeat(np.arange(len(at)), c)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(c) - c, c)
                pair = (np.minimum(mine[copy], other) << 32 | np.maximum(mine[copy], other)).view(np.uint64)
                token, at, position = np.where(c[copy] == 1, token[copy], tk.short(tk.mix(token[copy].astype(np.uint64)) + pair)), at[copy], position[copy]
            part = (tk.mix(token.astype(np.uint64)) % np.uint64(n)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            at, cut = at[by], np.flatnonzero(np.r_[True, np.diff(part[by]) != 0]) if len(by) else np.zeros(0, np.int64)
            values = {"token": token[by], "position": position[by]}
            for name, kind, wide in columns:
                if name not in values:
                    column = batch.column(name)
                    whole = tk.unpacked(column, np.uint64)[0].reshape(-1, wide) if wide > 1 else column.to_numpy(zero_copy_only=False)
                    values[name] = whole[at]
            ends = np.r_[cut[1:], len(by)]
            blobs = [b"".join(_planes(values[name][i:j], kind, wide) for name, kind, wide in columns) for i, j in zip(cut, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part[by][cut]), pa.array((ends - cut).astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "n", "rows"])

    found = heads.select("nid", "size", "bits", "bits2", "prefix", *more).mapInArrow(run, "part int, n int, rows binary")
    return found.repartitionById(n, "part")


def _planes(values: np.ndarray, kind: np.dtype, wide: int) -> bytes:
    """The bytes of equal rank together: high ones, mostly equal, compress to nothing."""
    return np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, kind.itemsize * wide).T.tobytes()


def _unplaned(blob: bytes, n: int, columns: list[tuple[str, np.dtype, int]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind, wide in columns:
        width = kind.itemsize * wide
        value = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind)
        out[name] = value if wide > 1 else value[:, 0]
        at += n * width
    return out


def _made(rows: dict[str, np.ndarray], similarity: float, most: int | None, earlier: bool, connect: bool) -> pa.RecordBatch:
    later, soon, more = candidates(rows, similarity, most, earlier, connect)
    # The same pair under many tokens of one batch is one row.
    by = np.lexsort((soon, later))
    start = np.flatnonzero(np.r_[True, (later[by][1:] != later[by][:-1]) | (soon[by][1:] != soon[by][:-1])]) if len(by) else np.zeros(0, np.int64)
    any_more = np.logical_or.reduceat(more[by], start) if len(start) else more
    times = np.diff(np.r_[start, len(by)])
    by = by[start]
    return pa.RecordBatch.from_arrays([pa.array(later[by]), pa.array(soon[by]), pa.array(any_more), pa.array(times.astype(np.int64))], ["later", "earlier", "more", "n"])


def _by_packed(similarity: float, most: int | None, earlier: bool, connect: bool, more: tuple[str, ...]):
    columns = _columns(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unplaned(blob, n, columns) for batch in batches for n, blob in zip(batch.column("n").to_pylist(), batch.column("rows").to_pylist())]
        if not held:
            return
        rows = {}
        for name, _, _ in columns:
            rows[name] = np.concatenate([x.pop(name) for x in held])
        key = rows.pop("token").astype(np.int64) << 32 | rows.pop("size")
        by = np.argsort(key, kind="stable")
        group = key[by] >> 32
        k = 0
        while k < len(by):
            # Whole groups only.
            until = int(np.searchsorted(group, group[min(k + PART, len(by)) - 1], "right"))
            which = by[k:until]
            yield _made({"key": key[which]} | {c: v[which] for c, v in rows.items()}, similarity, most, earlier, connect)
            k = until

    return run


def _by_group(similarity: float, most: int | None, earlier: bool, connect: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        made = lambda rows: _made(rows, similarity, most, earlier, connect)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "sketch"}
            if "sketch" in batch.schema.names:
                rows["sketch"] = tk.unpacked(batch.column("sketch"), np.uint64)[0].reshape(-1, tk.SKETCH)
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in rows}
            group = rows["key"] >> 32
            cut = int(np.searchsorted(group, group[-1]))  # sorted: the last group is the tail
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield made({c: v[:cut] for c, v in rows.items()})
        if held is not None:
            yield made(held)

    return run


PAIRS = "later long, earlier long, more boolean, n long"


def _cell(text_key: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and the bit in it for each place."""
    number = tk.mix(text_key.view(np.uint64) ^ tk.mix(line.astype(np.uint64) + np.uint64(1)))
    return (number % np.uint64(size)).astype(np.int32), (np.uint64(1) << (number >> np.uint64(58))).view(np.int64)


def fetch(found: Found, wanted: DataFrame) -> DataFrame:
    """wanted: nid, node, text_key and line of some nodes. (nid, words, sketch): their whole sets and
    their parity bits at large, rarest token first. A filter of bounded size over their first places
    keeps other sets from being made; beyond its bound there is none."""
    spark = wanted.sparkSession
    size, number = 1 << 10, wanted.count()
    while size < FILTER and size < number:
        size *= 2
    kept = None
    if number <= 16 * FILTER:

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*map(pa.array, _cell(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size))], ["k", "b"])

        found_cells = wanted.select("text_key", "line").mapInArrow(cells, "k int, b long").groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(size, np.int64)
        table[found_cells["k"].to_numpy()] = found_cells["b"].to_numpy()
        kept = spark.sparkContext.broadcast(table)
    split, classes = found.split, found.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)

            def wanted(row: np.ndarray, line: np.ndarray, key: np.ndarray = key) -> np.ndarray:
                k, bit = _cell(key[row], line, size)
                return kept.value[k] & bit != 0

            # Other lines are not even cut into words.
            row, line, number = split(batch.column(0), **({"wanted": wanted} if kept is not None else {}))
            sets = tk.Sets(row, line, number, classes.value)
            node, which = np.unique(sets.node(), return_index=True)
            sketch = sets.sketch(which)
            yield pa.RecordBatch.from_arrays([pa.array(node), tk.binary(*sets.take(which)), tk.binary(sketch.ravel(), np.arange(len(which) + 1) * tk.SKETCH)], ["node", "words", "sketch"])

    sets = found.rows.select("text", "text_key").mapInArrow(run, "node long, words binary, sketch binary")
    sets = sets.groupBy("node").agg(F.max("words").alias("words"), F.max("sketch").alias("sketch"))
    return found.scratch.write(sets.join(wanted.select("nid", "node"), "node").select("nid", "words", "sketch"), "whole-sets")


def verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (later, earlier) whose similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at_a), (b, at_b) = (tk.unpacked(batch.column(c), np.uint64) for c in ("a", "b"))
            s, t = np.diff(at_a), np.diff(at_b)
            ok = np.zeros(batch.num_rows, bool)
            total, k = np.cumsum(s + t), 0
            while k < len(ok):
                until = max(k + 1, min(k + tk.TOGETHER, int(np.searchsorted(total, (total[k - 1] if k else 0) + (1 << 18), "right"))))
                pair = np.arange(until - k, dtype=np.uint64) << np.uint64(tk.CLASS + tk.CODE)
                both = np.sort(np.concatenate((np.repeat(pair, s[k:until]) | a[at_a[k] : at_a[until]], np.repeat(pair, t[k:until]) | b[at_b[k] : at_b[until]])))
                equal = both[1:][both[1:] == both[:-1]]
                common = np.bincount((equal >> np.uint64(tk.CLASS + tk.CODE)).astype(np.int64), minlength=until - k)
                ok[k:until] = common >= tk.ceil(similarity / (1 + similarity) * (s + t)[k:until])
                k = until
            yield batch.select(["later", "earlier"]).filter(pa.array(ok))

    met = pairs.select("later", "earlier").join(sets.select(F.col("nid").alias("later"), F.col("words").alias("a")), "later")
    met = met.join(sets.select(F.col("nid").alias("earlier"), F.col("words").alias("b")), "earlier")
    return met.select("later", "earlier", "a", "b").mapInArrow(run, "later long, earlier long")


def roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    return scratch.write(connected_components(links, "later", "earlier").select(F.col("node").alias("nid"), "root"), "set-roots")


def joined(found: Found, earlier: bool, connect: bool, seeds: DataFrame | None = None) -> DataFrame:
    """(later, earlier): verified pairs, enough of them that each node with an earlier match has
    one (``earlier``) and that the components over them are those over all matches (``connect``).
    seeds: pairs to be tried before any token is looked at."""
    scratch, s = found.scratch, found.similarity
    tried = links = sets = within = None
    hot, small = common_tokens(scratch, found.heads)
    if seeds is not None:
        tried = scratch.write(seeds.select("later", "earlier").distinct(), "seed-pairs")
        sets = fetch(found, _named(found, tried))
        links = scratch.write(verified(sets, tried, s), "set-links")
    for k, most in enumerate(ROUNDS):
        # From the second round on only nodes that have candidates, known by the first.
        heads, columns = found.heads if k == 0 else within, () if k == 0 else ("sketch",)
        if links is not None:
            heads, state = _state(scratch, heads, links, earlier, connect)
            columns = (*state, *columns)
        if small:
            rows = packed(heads, hot, columns).mapInArrow(_by_packed(s, most, earlier, connect, columns), PAIRS)
        else:
            rows = dealt(heads, hot, columns).mapInArrow(_by_group(s, most, earlier, connect), PAIRS)
        pairs = scratch.write(rows.groupBy("later", "earlier").agg(F.max("more").alias("more"), F.sum("n").alias("n")), "set-pairs")
        if k == 0:
            nodes = scratch.write(pairs.select(F.explode(F.array("later", "earlier")).alias("nid")).where("nid >= 0").distinct(), "met-nodes")
            within = scratch.write(found.heads.join(counted(nodes, MET), "nid", "left_semi"), "met-heads")
            sets = fetch(found, within)
            within = within.join(sets.select("nid", "sketch"), "nid")
            # Of several candidates, the one that shares most tokens of the prefix.
            ranked = pairs.where("earlier >= 0").groupBy("later").agg(F.max_by("earlier", F.struct("n", -F.col("earlier"))).alias("earlier"), (F.count(F.lit(1)) > 1).alias("other"), F.max("more").alias("more"))
            ranked = scratch.write(ranked, "best-pairs")
            new, more = ranked.select("later", "earlier"), ranked.where("other or more").limit(1)
        else:
            new, more = pairs.where("earlier >= 0").select("later", "earlier"), pairs.where("more").limit(1)
        if tried is not None:
            new = scratch.write(new.join(tried, ["later", "earlier"], "left_anti"), "new-pairs")
        got = scratch.write(verified(sets, new, s), "set-links")
        tried = new if tried is None else tried.unionByName(new)
        links = got if links is None else links.unionByName(got)
        done = more.isEmpty()
        scratch.forget("set-pairs")
        if done:
            break
    found.sets = sets
    return links


def _overlapping(sets: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """sets: tokens, their offsets, copies and piece, by size; one piece or two. For each set the
    copies of the sets it matches: of its own piece if there is one, else of the other."""
    words, at, copies, piece = sets
    token, word = np.unique(words, return_inverse=True)
    size, total, here = np.diff(at), np.zeros(len(copies), np.int64), np.zeros(len(token), bool)
    alone = bool((piece == piece[0]).all())
    low = np.searchsorted(size, tk.ceil(similarity * size))
    for k in range(len(size)):
        # The smaller of two counts for both.
        a = low[k]
        if a == k:
            continue
        here[word[at[k] : at[k + 1]]] = True
        both = np.add.reduceat(here[word[at[a] : at[k]]], at[a:k] - at[a], dtype=np.int64)
        here[word[at[k] : at[k + 1]]] = False
        ok = both >= tk.ceil(similarity / (1 + similarity) * (size[k] + size[a:k]))
        if not alone:
            ok &= piece[a:k] != piece[k]
        total[k] += copies[a:k][ok].sum()
        total[a:k][ok] += copies[k]
    return total


def matched(found: Found, nodes: DataFrame) -> DataFrame:
    """nodes: nid, root, copies and the number of ``nodes`` of the component, for all nodes of some
    components; more columns may follow. Those columns and ``matches``: the copies of all other nodes
    whose similarity is high enough. Every pair of pieces of a component is a group, so a task holds two."""
    spark, s = nodes.sparkSession, found.similarity
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = found.sets.select("nid", "words").join(counted(nodes), "nid")
    c = F.ceil(F.col("nodes") / PIECE).cast("int")
    met = met.withColumn("mine", F.pmod(F.xxhash64("nid"), c).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c - 1)))
    group = F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other"))
    # Within the pair of a piece and another, only pairs across count; the piece has a group of its own.
    met = met.select(group.alias("group"), F.octet_length("words").alias("width"), "mine", "root", "words", "nid", "copies", *[x for x in nodes.columns if x not in ("nid", "root", "copies", "nodes")])
    dealt = met.repartition(n, "group").sortWithinPartitions("group", "root", "width")
    kept = [x for x in nodes.columns if x not in ("root", "nodes")]
    schema = ", ".join([*[f"{x} {nodes.schema[x].dataType.simpleString()}" for x in kept], "matches long"])

    def compared(rows: pa.RecordBatch) -> pa.RecordBatch:
        words, at = tk.unpacked(rows.column("words"), np.uint64)
        group, root, copies, piece = (rows.column(x).to_numpy() for x in ("group", "root", "copies", "mine"))
        start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (root[1:] != root[:-1])])
        total = np.zeros(len(group), np.int64)
        for i, j in zip(start, np.r_[start[1:], len(group)]):
            total[i:j] = _overlapping((words[at[i] : at[j]], at[i : j + 1] - at[i], copies[i:j], piece[i:j]), s)
        return pa.RecordBatch.from_arrays([*[rows.column(x) for x in kept], pa.array(total)], [*kept, "matches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            if held and held[0].column("group")[0].as_py() != group[0]:
                yield compared(pa.concat_batches(held))
                held = []
            cut = int(np.flatnonzero(group == group[-1])[0])  # sorted: the last group is the tail
            if cut:
                yield compared(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compared(pa.concat_batches(held))

    return dealt.mapInArrow(run, schema).groupBy(*kept).agg(F.sum("matches").alias("matches"))


def _named(found: Found, pairs: DataFrame) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("later", "earlier")).alias("nid")).distinct()
    return found.scratch.write(found.heads.select("nid", "node", "text_key", "line").join(nodes, "nid", "left_semi"), "wanted-nodes")


def _state(scratch: Scratch, heads: DataFrame, links: DataFrame, earlier: bool, connect: bool) -> tuple[DataFrame, tuple[str, ...]]:
    """heads with what decides whether a pair is still needed, and the names of those columns: the root
    of the node's component over the links so far (``connect``), and whether it lacks an earlier match
    (``earlier``). With true roots a large group that is connected already asks for no pair again."""
    met = heads.drop("root", "open")
    if connect:
        met = met.join(roots(scratch, links), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    if earlier:
        done = scratch.write(links.select(F.col("later").alias("nid")).distinct().withColumn("done", F.lit(True)), "matched-nodes")
        met = met.join(done, "nid", "left").withColumn("open", F.col("done").isNull()).drop("done")
    return met, (*(("root",) if connect else ()), *(("open",) if earlier else ()))
