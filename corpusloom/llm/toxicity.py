"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean text under Dirichlet priors; a rare word leans on its
prefixes. A linear scan (Ruzzo and Tompa, 1999) finds every maximal segment of a text. Segment
scores are judged by extreme-value statistics (Karlin and Altschul, 1990): a segment of score s in
n words has E = K n exp(-lambda s) chance finds in clean text. A document's best E and the sum of
its significant segments are calibrated to a probability.

The model is fitted on the driver from at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean
labelled documents chosen by a hash of the id, and keeps at most ``WORDS`` words: a fixed size
that is broadcast. The calibration is cross-fitted: half the sample is scored by a model of the
other half. Scoring handles every row alone in Arrow batches: no shuffle, whole texts.

Defined cases: a null or empty text is scored as a text without segments; a label that is neither
0 nor 1 is no label; rows that repeat a label count as toxic if any is; without both classes the
score is the share of toxic labels (0 without labels); rows repeating a doc_id each give a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnt_from, map_pandas, table

TRAIN_TOXIC, TRAIN_CLEAN, WORDS = 3_000, 6_000, 150_000
#: Tokens of prior in proportion to use, beside half a token for each word, and observations at which a word counts as much as its prefix.
PRIOR, LEAN = 1_000.0, 4.0
PREFIXES = (4, 5, 7)
#: A segment is significant if clean text gives at most so many like it in a document.
SIGNIFICANT = 0.05
CACHE = 300_000
THRESHOLD = 0.3


def token(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}<>«»„“”‚‘’…-–—*_#|&")


def log_odds(toxic: Counter, clean: Counter) -> dict[str, tuple[float, int]]:
    """Log-odds of each item with a Dirichlet prior in proportion to its overall use; its count."""
    a, b = sum(toxic.values()), sum(clean.values())
    out = {}
    for w in toxic.keys() | clean.keys():
        x, y = toxic[w], clean[w]
        prior = 0.5 + PRIOR * (x + y) / (a + b)
        out[w] = (math.log((x + prior) / (a + PRIOR - x - prior + 1)) - math.log((y + prior) / (b + PRIOR - y - prior + 1)), x + y)
    return out


class Lexicon:
    """Scores of words; unknown words take the score of their longest known prefix."""

    def __init__(self, toxic: list[str], clean: list[str]) -> None:
        count = [Counter(map(token, " ".join(t).split())) for t in (toxic, clean)]
        by_length = {}
        for n in PREFIXES:
            parts = [Counter() for _ in count]
            for own, part in zip(count, parts):
                for w, c in own.items():
                    if len(w) >= n:
                        part[w[:n]] += c
            by_length[n] = log_odds(*parts)
        self.prefix: dict[str, float] = {}
        for n in PREFIXES:
            for w, (d, c) in sorted(by_length[n].items(), key=lambda x: (-x[1][1], x[0]))[:WORDS]:
                self.prefix[w] = (c * d + LEAN * self._lean(w, n)) / (c + LEAN)
        self.word = {w: (c * d + LEAN * self._lean(w, len(w) + 1)) / (c + LEAN) for w, (d, c) in sorted(log_odds(*count).items(), key=lambda x: (-x[1][1], x[0]))[:WORDS]}

    def _lean(self, w: str, shorter: int) -> float:
        return next((self.prefix[w[:n]] for n in reversed(PREFIXES) if n < shorter and n <= len(w) and w[:n] in self.prefix), 0.0)

    def score(self, raw: str) -> float:
        w = token(raw)
        return self.word[w] if w in self.word else 0.5 * self._lean(w, len(w) + 1)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), found in linear time."""
    total = np.cumsum(score)
    begin, end, left, right, smaller = [], [], [], [], []  # smaller: the last before with a smaller left sum
    for i in np.flatnonzero(score > 0).tolist():
        a, l, r = i, float(total[i] - score[i]), float(total[i])
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = smaller[j]
            if j < 0 or right[j] >= r:
                begin.append(a), end.append(i + 1), left.append(l), right.append(r), smaller.append(j)
                break
            a, l, k = begin[j], left[j], j
            j = smaller[j]
            del begin[k:], end[k:], left[k:], right[k:], smaller[k:]
    return [(a, b, r - l) for a, b, l, r in zip(begin, end, left, right)]


class Scorer:
    """Lexicon and extreme-value statistics of clean text."""

    def __init__(self, toxic: list[str], clean: list[str]) -> None:
        self.lexicon, self.kept = Lexicon(toxic, clean), {}
        self.drift = 0.0
        values = [self.values(t) for t in clean]
        every = np.concatenate([*values, np.zeros(1)])
        # Clean text must drift down, or every text would be one segment.
        self.drift = float(every.mean() + every.std() + 0.5)
        every = every - self.drift
        self.rate = self._rate(every)
        best = np.array([max((s for *_, s in segments(v - self.drift)), default=0.0) for v in values])
        n = np.array([max(1, len(v)) for v in values])
        self.k = len(best) / max(1e-9, float((n * np.exp(-self.rate * best)).sum()))

    @staticmethod
    def _rate(x: np.ndarray) -> float:
        """The positive root of mean(exp(rate * x)) = 1."""
        if x.max() <= 0:
            return 1.0
        low, high = 0.0, 1.0
        over = lambda r: float(np.exp(np.minimum(r * x, 700)).mean()) > 1
        while not over(high) and high < 64:
            low, high = high, 2 * high
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if over(mid) else (mid, high)
        return high

    def values(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if len(self.kept) > CACHE:
            self.kept = {}
        for w in set(words):
            if w not in self.kept:
                self.kept[w] = self.lexicon.score(w)
        return np.fromiter(map(self.kept.__getitem__, words), np.float64, len(words)) - self.drift

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], float, float]:
        """Significant segments as (first word, end, E); the log of the least E, and the sum of
        what the significant ones score in units of the rate."""
        v = self.values(text)
        base = math.log(self.k * max(1, len(v)) + 1e-12)
        every = [(a, b, base - self.rate * s) for a, b, s in segments(v)]
        significant = [x for x in every if x[2] <= math.log(SIGNIFICANT)]
        # Of the logarithms: E itself is 0 for a passage long and dense enough.
        return [(a, b, math.exp(e)) for a, b, e in significant], min([base, *(e for *_, e in every)]), sum(-e for *_, e in significant)


class Model:
    def __init__(self, texts: list[str], toxic: list[int], rate: float) -> None:
        """rate: the share of toxic among all labels, which the sample need not have."""
        self.constant = rate
        y = np.array(toxic, dtype=np.int64)
        self.scorer = None
        if len(set(toxic)) < 2:
            return
        part = lambda keep, of: [t for t, k, v in zip(texts, keep, y) if k and v == of]
        half = np.arange(len(y)) % 2 == 0
        x = np.zeros((len(y), 3))
        for own in (half, ~half):
            if len({*y[~own].tolist()}) < 2:
                continue
            s = Scorer(part(~own, 1), part(~own, 0))
            for i in np.flatnonzero(own):
                x[i] = self.features(s, texts[i])[1]
        self.scorer = Scorer(part(y >= 0, 1), part(y >= 0, 0))
        weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.beta = self._logistic((x - self.mean) / self.scale, y, weight)

    @staticmethod
    def features(scorer: Scorer, text: str | None) -> tuple[list, np.ndarray]:
        found, least, total = scorer.passages(text)
        return found, np.array([math.log1p(math.exp(min(50.0, -least))), math.log1p(total), float(len(found) > 0)])

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Ridge logistic regression by Newton steps; the first coefficient is the intercept."""
        x = np.c_[np.ones(len(x)), x]
        beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (weight * (p - y)) + ridge @ beta
            beta = beta - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, grad)
        return beta

    def judge(self, text: str | None) -> tuple[float, str]:
        """Probability of toxicity, and its passages as ranges of word numbers."""
        if self.scorer is None:
            return self.constant, ""
        found, x = self.features(self.scorer, text)
        z = float(self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), ",".join(f"{a}:{b}" for a, b, _ in found)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from a bounded sample of labels (doc_id, toxic) and the texts they name."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(toxic).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], [], 0.0)
    rate = counts.get(1, 0) / sum(counts.values())
    share = lambda y, most: min(1.0, most / max(1, counts.get(y, 0)))
    limit = F.when(F.col("y") == 1, share(1, TRAIN_TOXIC)).otherwise(share(0, TRAIN_CLEAN)) * (1 << 30)
    most = 2 * (TRAIN_TOXIC + TRAIN_CLEAN)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 30)) < limit).groupBy("id").agg(F.max("y").alias("y")).limit(most)
    # At most ``most`` rows, so a broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    found = rows.join(F.broadcast(chosen), "id").select("id", "text", "y").limit(most).toPandas().sort_values("id")
    return Model(found["text"].tolist(), found["y"].tolist(), rate)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            judged = [model.judge(t) for t in batch["text"]]
            score = np.array([s for s, _ in judged], dtype=np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32), "passages": [p for _, p in judged]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    return map_pandas(rows, run, "doc_id long, held_out boolean, score double, predicted int, passages string")


def op7_segment_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return predict(docs, fit(docs, labels.where(learnt_from(F.col("doc_id")))))
