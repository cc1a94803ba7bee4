"""Language identification by script ranges and Viterbi over words.

Each word is scored for each language from its letter n-grams; the scripts of its letters narrow
the candidates to languages seen in that script. Viterbi with a switching penalty then labels
every word, so passages of a mixed text get spans of their own; the language with most letters is
the prediction and its share of the letters the score.

The model is fitted on the driver from at most ``TRAIN`` documents for each of at most
``LANGUAGES`` languages, chosen by a hash of the id; it keeps at most ``GRAMS`` n-grams and is
broadcast. Prediction handles every row alone in Arrow batches: no shuffle, whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if
nothing can be learnt; rows repeating a doc_id each give a row; ties go to the language that
comes first in the alphabet; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnt_from, map_pandas, table

TRAIN, LANGUAGES, GRAMS = 2_000, 200, 120_000
PENALTY = 8.0
#: Documents whose paths are searched together, and words whose scores a worker keeps.
TOGETHER, CACHE = 2_048, 300_000

#: Ranges of code points by script; other letters count as "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
NAMES = [*SCRIPTS, "other"]
_EDGES = sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])


def script(c: str) -> int:
    o = ord(c)
    return next((k for a, b, k in _EDGES if a <= o <= b), len(NAMES) - 1)


def letters(word: str) -> str:
    """The letters of a word in lower case."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams(word: str) -> list[str]:
    """Pairs and triples of letters of a word with its edges, and the word itself."""
    w = f"^{word}$"
    return [w, *[w[i : i + 2] for i in range(len(w) - 1)], *[w[i : i + 3] for i in range(len(w) - 2)]]


class Model:
    """Log-odds of n-grams by language against their mean, and scripts by language."""

    def __init__(self, texts: list[str], labels: list[str]) -> None:
        self.languages = sorted(set(labels))
        index = {x: k for k, x in enumerate(self.languages)}
        count = [Counter() for _ in self.languages]
        words = [Counter() for _ in self.languages]
        for text, label in zip(texts, labels):
            words[index[label]].update(text.lower().split())
        scripts = np.zeros((len(self.languages), len(NAMES)))
        for k, own in enumerate(words):
            for raw, n in own.items():
                if word := letters(raw):
                    for c in word:
                        scripts[k, script(c)] += n
                    for g in grams(word):
                        count[k][g] += n
        total = Counter()
        for c in count:
            total.update(c)
        self.grams = {g: i for i, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:GRAMS])}
        n = np.array([[c[g] for c in count] for g in self.grams], dtype=np.float64).reshape(len(self.grams), len(self.languages))
        p = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * len(n) + 1e-9)
        self.weights = (p - p.mean(axis=1, keepdims=True)).astype(np.float32)
        self.known = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) > 0.001
        n = np.array([labels.count(x) for x in self.languages], dtype=np.float64)
        self.prior = n / n.sum() if n.sum() else n

    def _seen(self, word: str) -> np.ndarray:
        """Languages that use the scripts of a word's first and last letter."""
        return self.known[:, [script(word[0]), script(word[-1])]].all(axis=1)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages) of words in lower case, zeros without letters; letters."""
        get, flat, ends, sizes, other = self.grams.get, [], [], [], {}
        for k, raw in enumerate(words):
            word = letters(raw)
            sizes.append(len(word))
            if word:
                flat += [i for g in grams(word) if (i := get(g)) is not None]
                if max(word) > "\u024f":
                    other[k] = word
            ends.append(len(flat))
        total = np.zeros((len(flat) + 1, len(self.languages)))
        np.cumsum(self.weights[flat], axis=0, out=total[1:])
        ends = np.array(ends, dtype=np.int64)
        # n-grams of a word overlap: their sum is tempered.
        out = ((total[ends] - total[np.r_[0, ends[:-1]]]) / 2).astype(np.float32)
        sizes = np.array(sizes, dtype=np.int64)
        plain = sizes > 0
        plain[list(other)] = False
        for rows, seen in [(plain, self._seen("a")), *((k, self._seen(w)) for k, w in other.items())]:
            if seen.any():
                out[rows] -= np.where(seen, 0, 20).astype(np.float32)
        return out, sizes


def viterbi(score: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word. score: (words, languages), texts one after the other."""
    n, k = score.shape
    path = np.zeros(n, np.int16)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return path
    starts, lengths = starts[order], lengths[order]
    # active[t]: texts with more than t words; they come first.
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    best_from, stay = np.zeros(n, np.int16), np.ones((n, k), bool)
    v = score[starts].copy()
    for t in range(1, int(lengths[0])):
        a = active[t]
        at = starts[:a] + t
        head = v[:a]
        top = head.argmax(axis=1)
        jump = head[np.arange(a), top] - penalty
        keep = head >= jump[:, None]
        best_from[at], stay[at] = top, keep
        v[:a] = np.where(keep, head, jump[:, None]) + score[at]
    now = v.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        own = now[:a]
        path[at] = own
        if t:
            now[:a] = np.where(stay[at, own], own, best_from[at])
    return path


class Labeller:
    """Labels texts with a model; keeps the scores of words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of the table for distinct words; new ones are scored and added."""
        if len(self.at) > CACHE:
            self._forget()
        new = [w for w in words if w not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            score, sizes = self.model.score(new)
            self.table, self.sizes = np.concatenate((self.table, score)), np.concatenate((self.sizes, sizes))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """(language, score, spans of word numbers) of each text."""
        m = self.model
        k = len(m.languages)
        lists = pc.ascii_split_whitespace(pc.utf8_trim(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), " \t\n\x0b\x0c\r"))
        coded = lists.flatten().dictionary_encode()
        if not k or not len(coded):
            return [("und", 0.0, "")] * len(texts)
        ids = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = np.diff(lists.offsets.to_numpy())
        score, size = self.table[ids], self.sizes[ids].astype(np.float64)
        path = viterbi(score, lengths, PENALTY)
        text = np.repeat(np.arange(len(texts)), lengths)
        share = np.bincount(text * k + path, weights=size, minlength=len(texts) * k).reshape(len(texts), k)
        total = share.sum(axis=1)
        pick = (share + 1e-6 * m.prior).argmax(axis=1)
        starts = np.cumsum(lengths) - lengths
        out = []
        for i, n in enumerate(lengths.tolist()):
            if not total[i]:
                out.append(("und", 0.0, ""))
                continue
            own = path[starts[i] : starts[i] + n]
            cut = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, n].tolist()
            spans = ",".join(f"{m.languages[own[a]]}:{a}:{b}" for a, b in zip(cut, cut[1:]))
            out.append((m.languages[pick[i]], float(share[i, pick[i]] / total[i]), spans))
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from a bounded sample of the labelled rows of docs."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(id_col).alias("id")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model([], [])
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, TRAIN / r["n"])))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))
    found = chosen.select("text", "lang").limit(2 * TRAIN * LANGUAGES).toArrow()
    return Model(found["text"].to_pylist(), found["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, word_spans) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value)
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.iloc[k : k + TOGETHER]
                out = pd.DataFrame(labeller.label(part["text"].tolist()), columns=["lang_pred", "score", "word_spans"])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").array)
                out.insert(1, "held_out", part["held_out"].to_numpy())
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    return map_pandas(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, word_spans string")


def op4_viterbi_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(learnt_from(F.col("doc_id")))))
