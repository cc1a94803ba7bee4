"""Packing along a space-filling curve.

Token ids are hashed into a vector per document, projected to three dimensions and mapped to a
Hilbert key. Documents are range-sorted by (key, doc_id), so neighbours on the curve, and with them
similar documents, share sequences. Each range is one continuous run of tokens cut every ``LENGTH``
ids; what is left at a range's end is cut into powers of two, so nothing is padded.

Texts are tokenised once; ids are written as two-byte numbers and the range sort moves only them.
A key that many documents share is split by doc_id. Ranges are independent: no prefix sum over
the corpus, no task that sees more than its range, and an open sequence is all the state there is.

Defined cases: a null or empty text has one token, the end mark; rows repeating a doc_id are
packed each; ties of the curve go by doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_tokenizer
from .common import map_pandas, materialize, table

LENGTH = 2048
END = 1
FEATURES, DIMS, BITS = 1024, 3, 16
#: Printed ASCII, and the pieces that the tokenizer cuts it into.
PRINTED = re.compile(r"[!-~]+")
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")
#: Words whose ids a worker keeps at once.
CACHE = 150_000

#: Documents encoded together.
TOGETHER = 1_024

_cache: dict[tuple[str, str], tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary uses for each byte: itself if printable, else the
    next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts. The tokenizer's pieces never span white space, so Arrow splits the
    texts and each distinct word is encoded once. Words of printed ASCII and of Latin letters go
    piece by piece to the merge model; the ids of a piece are kept, longer if it recurs. Others
    take the whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # Ids are kept in two bytes.
        if max(read_tokenizer(path)["model"]["vocab"].values()) >= 1 << 16:
            raise ValueError(f"more than 65,536 ids: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.young.get(piece)
            if got is not None:
                self.old[piece] = got
            else:
                text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                got = self.young[piece] = array("H", [t.id for t in self.merge(text)]).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        """Ids of a word whose ASCII is in lower case."""
        if word.isascii():
            if word.isalpha():
                return self._piece(word)
            if word[-1] in ".," and word[:-1].isalpha():
                return self._piece(word[:-1]) + self._piece(word[-1])
            if PRINTED.fullmatch(word):
                return b"".join(map(self._piece, PIECES.findall(word)))
            return self._whole(word)
        stop = word[-1] if word[-1] in ".," else ""
        body = word[:-1] if stop else word
        # Letters that are composed already and have one lower-case form.
        if body.isalpha() and max(body) <= "\u024f" and "\u0130" not in body:
            return self._piece(body.lower()) + (self._piece(stop) if stop else b"")
        return self._whole(word)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its ids and the end mark."""
        if len(self.young) > CACHE:
            self.young.clear()
        if len(self.old) > CACHE:
            self.old.clear()
        # A text that may spell a special token is left to the tokenizer; otherwise lower case
        # changes no id.
        special = {k: t for k, t in enumerate(texts) if t and "<|" in t}
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if t is None or k in special else t for k, t in enumerate(texts)], pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        found = [self._word(w) if w else b"" for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        start, ids, at = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u2"), coded.indices.to_numpy()
        per_word = size[at]
        end = np.r_[0, np.cumsum(per_word)]
        every = ids[np.repeat(start[at] - end[:-1], per_word) + np.arange(end[-1])]
        cut = end[lists.offsets.to_numpy()]
        mark = np.array([END], "<u2")
        return [np.concatenate((np.frombuffer(self._whole(special[k]), "<u2") if k in special else every[a:b], mark)) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))]


def encoder(path: str) -> Encoder:
    if path not in _cache:
        _cache[path] = Encoder(path)
    return _cache[path]


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points x (n, dims), after Skilling (2004)."""
    x = x.astype(np.int64).copy()
    dims, q = x.shape[1], 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Hilbert keys of hashed token counts."""
    directions = np.random.default_rng(seed).standard_normal((FEATURES, DIMS))
    vectors = np.empty((len(ids), DIMS))
    for k, one in enumerate(ids):
        counts = np.sqrt(np.bincount((one.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=FEATURES))
        vectors[k] = counts @ directions / np.linalg.norm(counts)
    unit = 1 / (1 + np.exp(-1.7 * vectors))  # near the normal distribution function
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """(doc_id, key, ids): ids as little-endian two-byte numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.iloc[k : k + TOGETHER]
                ids = e.ids(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "key": curve_keys(ids), "ids": [x.tobytes() for x in ids]})

    return map_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, key long, ids binary")


class Packer:
    """Packs one range. Sequence numbers are those of the range in the high bits."""

    def __init__(self, part: int, length: int, with_ids: bool) -> None:
        self.part, self.length, self.with_ids = part, length, with_ids
        self.n = self.filled = 0
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.length - self.filled, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        at, sequence = 0, (self.part << 40) | self.n
        for doc_id, start, ids, total in pieces:
            wide = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(wide), total, sequence, at, *([wide] if self.with_ids else [])))
            at += len(ids)
        self.n += 1

    def finish(self) -> None:
        """Cut what is open into powers of two, the largest first."""
        while self.filled:
            size = 1 << (self.filled.bit_length() - 1)
            taken, got = [], 0
            while got < size:
                doc_id, start, ids, total = self.open[0]
                take = min(size - got, len(ids))
                taken.append((doc_id, start, ids[:take], total))
                self.open[0] = (doc_id, start + take, ids[take:], total)
                if take == len(ids):
                    self.open.pop(0)
                got += take
            self._close(taken)
            self.filled -= size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; with_ids adds its ids as four-byte numbers."""
    rows = materialize(tokenised(docs, id_col, text, tokenizer or default_tokenizer()), "token-ids")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> pd.DataFrame:
            rows = pd.DataFrame([row[1:] for row in p.rows], columns=names[1:])
            rows.insert(0, "doc_id", pd.array([row[0] for row in p.rows], dtype="Int64"))
            p.rows = []
            return rows

        p = Packer(TaskContext.get().partitionId(), length, with_ids)
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].tolist(), batch["ids"]):
                p.add(None if doc_id is None or doc_id != doc_id else int(doc_id), np.frombuffer(ids, dtype="<u2"))
            yield out()
        p.finish()
        yield out()

    return map_pandas(ordered, run, SCHEMA + (", ids binary" if with_ids else ""))


def op6_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
