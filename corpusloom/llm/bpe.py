"""Byte-pair encoding and decoding over a trie of words.

The tokenizer cuts a text into words that merge on their own. The distinct words of an Arrow batch
are sorted and walked depth-first through a trie. A node stands for a prefix and holds the last token
of that prefix's encoding, which is all that an encoding needs to be continued: token t ends the
encoding of prefix p if p ends in t and t stays apart from the last token of p without t, that is, if
merging the two tokens' symbols gives the two back. One t does. So a prefix that many words share is
encoded once, and a word's ids are read back from its last node in steps of a token's length. A word's
last byte is a symbol of its own (the vocabulary marks it ``</w>``), so a leaf differs from the inner
node with the same letters.

Batches are independent: nothing is shuffled, no state is kept beyond a worker's trie, which starts
anew at ``NODES`` nodes. Nodes deeper than ``DEEP`` aren't kept, so a word of millions of bytes costs
two lists of its length. Normalisation and the cut into words of anything but printed ASCII and
composed Latin letters are the tokenizer file's own, taken from the library; merging never is.

Defined cases: a null or empty text has no ids and decodes to the empty text; the strings of added
tokens are those tokens; rows that repeat a doc_id are encoded each; an empty table gives no rows;
columns other than the id and the text are not read. Ids of rows go through Arrow unchanged, nulls
included. A tokenizer file of another kind is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Printed ASCII, and the words that the tokenizer cuts it into.
PRINTED = re.compile(r"[!-~]+")
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")
#: Nodes, pairs of tokens and words that a worker keeps; what goes beyond is worked out again.
NODES, PAIRS, KNOWN = 600_000, 400_000, 200_000
DEEP = 48
#: Added to the code point of a word's last letter.
LAST = 0x400

_codecs: dict[str, Codec] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary uses for each byte: itself if printable, else the next
    free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def spelled(token: str) -> str:
    """A token or word as one character a symbol."""
    return token[:-5] + chr(ord(token[-5]) + LAST) if token.endswith("</w>") and len(token) > 4 else token


class Merges:
    """The merge table, asked only whether two tokens stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        self.token = {spelled(t): i for t, i in vocab.items()}
        self.spelling = {i: t for t, i in self.token.items()}
        self.rank = {(spelled(a), spelled(b)): k for k, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.token))
        self.apart: dict[int, bool] = {}

    def merged(self, symbols: str) -> list[str]:
        """The plain algorithm: the first merge of the table that applies, leftmost first, until none does."""
        parts = list(symbols)
        while True:
            ranks = [self.rank.get(p, -1) for p in zip(parts, parts[1:])]
            best = min((r for r in ranks if r >= 0), default=-1)
            if best < 0:
                return parts
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stays(self, before: int, token: int) -> bool:
        """Whether ``token`` follows ``before`` in the encoding of both; before -1: whether it stays whole."""
        key = (before << 32) | token
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            own = [self.spelling[token]]
            parts = own if before < 0 else [self.spelling[before], *own]
            got = self.apart[key] = self.merged("".join(parts)) == parts
        return got


class Trie:
    """Last token, and its length, of the encoding of each prefix met so far."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.size: list[int] = [0]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the spelled words, which are in order: the walk goes back only to where a
        word leaves the one before."""
        if len(self.last) > NODES:
            self.clear()
        child, last, size, token, stays, longest = self.child, self.last, self.size, self.merges.token, self.merges.stays, self.merges.longest
        out, before = [], ""
        nodes, lasts, sizes = [0], [-1], [0]  # from the root to where the walk is
        for word in words:
            keep, most = 0, min(len(word), len(before))
            while keep < most and word[keep] == before[keep]:
                keep += 1
            del nodes[keep + 1 :], lasts[keep + 1 :], sizes[keep + 1 :]
            for d in range(keep, len(word)):
                key = (nodes[d] << 11) | ord(word[d]) if d < DEEP else -1
                node = child.get(key)
                if node is None:
                    d1 = d + 1
                    for n in range(min(d1, longest), 0, -1):
                        t = token.get(word[d1 - n : d1])
                        if t is not None and stays(lasts[d1 - n], t):
                            break
                    else:
                        raise ValueError("no token ends the prefix")
                    node = -1
                    if d < DEEP:
                        node = child[key] = len(last)
                        last.append(t)
                        size.append(n)
                else:
                    t, n = last[node], size[node]
                nodes.append(node)
                lasts.append(t)
                sizes.append(n)
            ids, d = [], len(word)
            while d:
                ids.append(lasts[d])
                d -= sizes[d]
            ids.reverse()
            out.append(ids)
            before = word
        return out


def read_tokenizer(path: str) -> dict:
    """The tokenizer file, if it is of the kind that is understood here."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    plain = model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
    steps = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])], [x.get("type") for x in cut.get("pretokenizers", [])]
    if not plain or steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or told.get("decoder") or told.get("post_processor") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
        raise ValueError(f"not a lower-case BPE with word ends: {path}")
    return told


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        told = read_tokenizer(path)
        model = told["model"]
        whole = Tokenizer.from_file(path)
        self.normalizer, self.cut = whole.normalizer, whole.pre_tokenizer
        self.letters = _byte_letters()
        self.trie = Trie(Merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]))
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.known: dict[str, bytes] = {}

    def _words(self, chunk: str) -> list[str]:
        """The words of a run without ASCII white space whose A-Z are lower-case, in byte letters."""
        if PRINTED.fullmatch(chunk):
            return [chunk] if chunk.isalpha() else WORDS.findall(chunk)
        # Letters that are composed already and have one lower-case form.
        if chunk.isalpha() and max(chunk) <= "ɏ" and "İ" not in chunk:
            return [chunk.lower().encode().decode("latin-1").translate(self.letters)]
        return [w for w, _ in self.cut.pre_tokenize_str(self.normalizer.normalize_str(chunk)) if w]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each distinct chunk as little-endian four-byte numbers."""
        cut = [self._words(c) for c in chunks]
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        new = sorted({w[:-1] + chr(ord(w[-1]) + LAST) for words in cut for w in words if w not in known})
        for w, ids in zip(new, self.trie.encode(new)):
            known[w[:-1] + chr(ord(w[-1]) - LAST)] = np.array(ids, "<u4").tobytes()
        return [known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words)) for words in cut]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        special = {k: t for k, t in enumerate(texts) if t and self.special and self.special.search(t)}
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if t is None or k in special else t for k, t in enumerate(texts)], pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        found = self._chunks([c or "" for c in coded.dictionary.to_pylist()])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, ids, at = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        per_chunk = size[at]
        end = np.r_[0, np.cumsum(per_chunk)]
        every = ids[np.repeat(start[at] - end[:-1], per_chunk) + np.arange(end[-1])]
        stops = end[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = [every[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
        for k, text in special.items():
            parts = self.special.split(text)
            between = self.ids(parts[::2])
            marks = [np.array([self.added[m]], "<u4") for m in parts[1::2]]
            out[k] = np.concatenate([x for pair in zip(between, [*marks, np.zeros(0, "<u4")]) for x in pair])
        return out

    def text(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a space between; ids outside the vocabulary have none."""
        names, n = self.names, len(self.names)
        return " ".join([t for i in ids.tolist() if i < n and (t := names[i]) is not None])


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """For each row its id, n_tokens, ids_sha256 of the ids as little-endian four-byte numbers,
    decoded_sha256 of the decoded text; on request the ids, so written, and that text."""
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    extra = [x for x, on in (("ids binary", with_ids), ("decoded string", with_decoded)) if on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = c.ids(batch.column(1).to_pylist())
            raw = [x.tobytes() for x in ids]
            texts, shas = [], []
            for x in ids:
                t = c.text(x)
                shas.append(hashlib.sha256(t.encode()).hexdigest())
                if with_decoded:
                    texts.append(t)
            columns = {id_col: batch.column(0), "n_tokens": pa.array(map(len, ids), pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), "decoded_sha256": pa.array(shas, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            if with_decoded:
                columns["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join([f"`{id_col}` {kind}", "n_tokens long, ids_sha256 string, decoded_sha256 string", *extra])
    return docs.select(F.col(id_col), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds the text of the ids (little-endian four-byte numbers); a null gives null."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("string")
    def run(column):
        c = codec(path)
        return column.map(lambda x: None if x is None else c.text(np.frombuffer(x, "<u4")))

    return rows.withColumn(out, run(F.col(ids)))


def op13_bpe_trie(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
