"""Terms of a large dictionary in texts, in one pass over each text however many terms there are.

The terms are sent to the workers once, as an Aho-Corasick automaton is built from them there. A term
counts where it stands between ASCII word boundaries, in any case, as ``text.has_term`` has it. A
dictionary of more than ``BLOCK_BYTES`` is dealt into blocks by hash, each a pass of its own, so what a
worker holds has a bound.

Defined cases: null and empty terms are no terms; a null text has none; terms that differ in case only are
found together; occurrences that overlap count each; repeated rows give rows each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms that one automaton is made of.
BLOCK_BYTES = 32 << 20
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


class _Folds(dict):
    """Code point to that of its simple case folding: lower case of its upper case, each one character."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        up = up if len(up) == 1 else chr(code)
        low = up.lower()
        self[code] = ord(low) if len(low) == 1 else ord(low[0]) if up == "İ" else ord(up)
        return self[code]


_FOLDS = _Folds()
#: The automaton that this worker built last, by the name of its terms.
_BUILT: dict[str, object] = {}


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def _automaton(name: str, terms: list[str], exact: bool):
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            key = term if exact else fold(term)
            found.add_word(key, (len(key), [*found.get(key, (0, []))[1], k]))
        if len(found):
            found.make_automaton()
        _BUILT[name] = found
    return _BUILT[name]


def _occurrences(automaton, text: str, exact: bool) -> dict[int, list[int]]:
    """Term number to its number of occurrences and the first's place."""
    low, out = text if exact else fold(text), {}
    for end, (length, numbers) in automaton.iter(low):
        start = end - length + 1
        if not exact:
            before, after = start > 0 and low[start - 1] in WORD, end + 1 < len(low) and low[end + 1] in WORD
            if before == (low[start] in WORD) or after == (low[end] in WORD):
                continue
        for k in numbers:
            out.setdefault(k, [0, start])[0] += 1
    return out


def found_terms(docs: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", term: str = "term", exact: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keys, term, n, first) for each row of docs and each distinct term of terms that stands in its text,
    n times, first at that code point. ``exact``: as a part of the text, case and boundaries regardless."""
    spark = docs.sparkSession
    every = terms.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct()
    total = every.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys]

    def scan(block: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(block.toArrow()["term"].to_pylist())
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, held.value, exact)
            for batch in batches:
                at, which, n, first = [], [], [], []
                for row, body in enumerate(batch.column(len(keys))):
                    body = body.as_py()
                    if not body or not len(automaton):
                        continue
                    for k, (times, place) in _occurrences(automaton, body, exact).items():
                        at.append(row)
                        which.append(held.value[k])
                        n.append(times)
                        first.append(place)
                some = batch.select(range(len(keys))).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(which, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], [*keys, "term", "n", "first"])

        return rows.mapInArrow(run, ", ".join([*kinds, "term string", "n bigint", "first bigint"]))

    out = None
    for k in range(blocks):
        one = scan(every.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k) if blocks > 1 else every)
        out = one if out is None else out.unionByName(one)
    return out
