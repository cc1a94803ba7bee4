"""Words and shingles of whole Arrow batches as numbers, without a Python object for each word.

A word ends at ASCII white space; A-Z count as a-z. Its number is a polynomial hash, modulo 2**64,
of one random value for each byte, taken from running sums over blocks of bytes; so a batch costs a
few passes of numpy however many words it has. A set is the sorted distinct tokens of a line or a
text. A token is a rarity class of ``CLASS`` bits, then ``CODE`` bits of the number: an order by
rarity, ties by hash, in one integer that is the same wherever the word stands.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
CLASS, CODE = 6, 48
#: Cells of the table that counts words: the top bits of their numbers.
CELLS = 20
#: Sets that one sort takes; with CLASS and CODE this fills 64 bits.
TOGETHER = 1 << (64 - CLASS - CODE)
BLOCK = 1 << 16
#: Words of 64 bits of a wide sketch; two bits of a hash choose one.
SKETCH = 4

_VALUE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, and where each row begins; a null is empty."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, number) of each word; no word goes on from one row to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # All but 9 to 13 and 32; bytes below 9 wrap round.
    black = (data - np.uint8(9) > 4) & (data != 32)
    begins, ends = black.copy(), black.copy()
    begins[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    inner = rows[(rows > 0) & (rows < len(data))]
    begins[inner], ends[inner - 1] = black[inner], black[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out, k = np.empty(len(start), np.uint64), 0
    # One value and one running sum for all blocks.
    values, sums = np.empty(BLOCK, np.uint64), np.zeros(BLOCK + 1, np.uint64)
    while k < len(start):
        until = max(k + 1, int(np.searchsorted(end, start[k] + BLOCK, "right")))
        base, n = start[k], int(end[until - 1] - start[k])
        # Kept for blocks; a longer word's own are dropped with it.
        p, q = _powers(BLOCK) if n <= BLOCK else _powers.__wrapped__(n)
        value, running = (values[:n], sums[: n + 1]) if n <= BLOCK else (np.empty(n, np.uint64), np.zeros(n + 1, np.uint64))
        np.take(_VALUE, data[base : base + n], out=value, mode="clip")
        value *= p[:n]
        np.cumsum(value, out=running[1:])
        s, e = start[k:until] - base, end[k:until] - base
        out[k:until] = (running[e] - running[s]) * q[s]
        k = until
    return start, mix(out)


#: Says of (row, line) which lines are to be cut into words.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _parts(data: np.ndarray, begin: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data is cut at the places ``begin``; the parts to take end to end, and where each begins."""
    n = np.diff(np.r_[begin, len(data)])
    return data[np.repeat(take, n)], np.r_[0, np.cumsum(n[take])]


def _of(start: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Index of the range each start lies in; ranges begin at ``begin`` and the last ends at its end."""
    return np.repeat(np.arange(len(begin) - 1), np.diff(np.searchsorted(start, begin)))


def lines(texts: pa.Array, wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line in the row, number) of each word; of the wanted lines, if that is given."""
    data, rows = text_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, rows)
    if wanted is None:
        start, number = words(data, rows)
        row = _of(start, rows)
        return row, _of(start, np.r_[0, breaks, len(data)]) - before[row], number
    n = np.diff(before) + 1
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    line = np.arange(len(row)) - first[row]
    begin = np.empty(len(row), np.int64)
    begin[line == 0], begin[line > 0] = rows[:-1], breaks + 1
    take = wanted(row, line)
    data, at = _parts(data, begin, take)
    start, number = words(data, at)
    which = np.flatnonzero(take)[_of(start, at)]
    return row[which], line[which], number


def shingles(texts: pa.Array, size: int, wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 0, number) of each run of ``size`` words of a row. A row of fewer words is one run,
    and a row without words the run of nothing. Only of the wanted rows, if that is given."""
    data, rows = text_bytes(texts)
    take = np.arange(len(texts))
    if wanted is not None:
        only = wanted(take, np.zeros(len(take), np.int64))
        take, (data, rows) = take[only], _parts(data, rows[:-1], only)
    start, number = words(data, rows)
    n = np.diff(np.searchsorted(start, rows))
    first = np.cumsum(n) - n
    runs = np.maximum(1, n - size + 1)
    row = np.repeat(np.arange(len(n)), runs)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    out = np.full(len(row), 0x5851F42D4C957F2D, np.uint64)
    for k in range(size):
        there = k < n[row]
        out[there] = mix(out[there] * np.uint64(BASE) + number[at[there] + k])
    return take[row], np.zeros(len(row), np.int64), out


def cell(number: np.ndarray) -> np.ndarray:
    return (number >> np.uint64(64 - CELLS)).astype(np.int64)


def classes(counts: np.ndarray) -> np.ndarray:
    """Rarity class of each cell: half octaves of its count."""
    return np.minimum((1 << CLASS) - 1, 2 * np.log2(np.maximum(1, counts))).astype(np.uint8)


class Sets:
    """Distinct tokens of each set, rarest first: ``row`` and ``line`` of the sets, ``start`` and
    ``size`` into ``token``."""

    def __init__(self, row: np.ndarray, line: np.ndarray, number: np.ndarray, rarity: np.ndarray) -> None:
        n = len(row)
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])]) if n else np.zeros(0, np.int64)
        self.row, self.line = row[first], line[first]
        token = (np.take(rarity, cell(number)).astype(np.uint64) << np.uint64(CODE)) | (number & np.uint64((1 << CODE) - 1))
        last = np.r_[first[1:], n]
        out, size, k = [], np.zeros(len(first), np.int64), 0
        while k < len(first):
            until = min(len(first), k + TOGETHER)
            until = max(k + 1, min(until, int(np.searchsorted(last, first[k] + (1 << 18), "right"))))
            a, b = first[k], last[until - 1]
            which = np.repeat(np.arange(until - k, dtype=np.uint64), (last - first)[k:until])
            both = np.sort((which << np.uint64(CLASS + CODE)) | token[a:b])
            both = both[np.r_[True, both[1:] != both[:-1]]]
            size[k:until] = np.bincount((both >> np.uint64(CLASS + CODE)).astype(np.int64), minlength=until - k)
            out.append(both & np.uint64((1 << (CLASS + CODE)) - 1))
            k = until
        self.token = np.concatenate(out) if out else np.zeros(0, np.uint64)
        self.size = size
        self.start = np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.size)

    def node(self) -> np.ndarray:
        """One number for each set, equal for equal sets."""
        if not len(self):
            return np.zeros(0, np.int64)
        whole = np.add.reduceat(mix(self.token + np.uint64(BASE)), self.start)
        return mix(whole + self.size.astype(np.uint64)).view(np.int64)

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity of the number of tokens by hash, in two words: two sets differ in at least as many
        tokens as bits."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashed = mix(self.token)
        bit, high = np.uint64(1) << (hashed & np.uint64(63)), hashed >> np.uint64(63) != 0
        return tuple(np.bitwise_xor.reduceat(np.where(on, bit, np.uint64(0)), self.start).view(np.int64) for on in (high, ~high))

    def sketch(self, which: np.ndarray) -> np.ndarray:
        """Parity as in bits(), in SKETCH words for each of the sets ``which``."""
        token, at = self.take(which)
        out = np.zeros((len(which), SKETCH), np.uint64)
        hashed = mix(token + np.uint64(1))
        word, bit = hashed >> np.uint64(62), np.uint64(1) << (hashed & np.uint64(63))
        for k in range(SKETCH if len(which) else 0):
            out[:, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at[:-1])
        return out

    def fingerprint(self) -> np.ndarray:
        """SimHash of each set: a bit is 1 if it is in over half of the tokens' hashes."""
        if not len(self):
            return np.zeros(0, np.int64)
        total = np.empty((len(self), 64), np.int64)
        hashed = mix(self.token ^ np.uint64(BASE))
        lanes = 1 << 14
        total[:] = 0
        of = np.repeat(np.arange(len(self)), self.size)
        for a in range(0, len(hashed), lanes):
            bit = np.unpackbits(hashed[a : a + lanes].view(np.uint8), bitorder="little").reshape(-1, 64)
            mine = of[a : a + lanes]
            cut = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            total[mine[cut]] += np.add.reduceat(bit, cut, axis=0, dtype=np.int64)
        return np.packbits(2 * total > self.size[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]

    def prefix_size(self, similarity: float) -> np.ndarray:
        return self.size - ceil(similarity * self.size) + 1

    def take(self, which: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the sets ``which``, or of each the first ``most``, and their offsets."""
        n = self.size[which] if most is None else most[which]
        at = np.r_[0, np.cumsum(n)]
        return self.token[np.repeat(self.start[which] - at[:-1], n) + np.arange(at[-1])], at


def ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.round(x, 6)).astype(np.int64)


def short(token: np.ndarray) -> np.ndarray:
    """Tokens in 32 bits, to group by: two that meet by chance cost a comparison, no result."""
    return (mix(token) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def binary(values: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A column of bytes: the values between the offsets, null where not valid."""
    width = values.dtype.itemsize
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [mask, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of bytes without nulls, and their offsets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.copy().view(kind), (at - at[0]) // np.dtype(kind).itemsize
