"""Toxicity by multiple-instance learning over sentences.

Only documents carry labels. Each sentence gets a probability from the words
in it, a document is toxic if any sentence is (noisy-or: 1 - prod(1 - p)), and
the sentence model is trained through that combination by gradient descent, so
that it learns which sentences offend. Words weigh by themselves and by their
beginnings and character 5-grams, which carries over to unseen inflections.

Edge cases: null, empty or wordless texts have no sentence and score 0; words of
any length weigh by all their features, and every sentence of a text of any
length enters its score; repeated label rows count once, toxic if any says so;
null labels are not learned from; of an id with several texts the one with the
smallest hash is learned from; with no labelled row, or one class only, every
score is 0 or the prior; equal texts have equal scores; repeated rows are scored
each by itself; columns other than ``doc_id`` and ``text`` are not read, so their
names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import map_batches

#: Labelled documents that are learned from, at most.
SAMPLE = 6000
#: Fewest sample documents of a feature; steps, their size, and the shrinkage
#: (in documents) that keeps rare features at nought.
MIN_DOCS, EPOCHS, RATE, SHRINK = 3, 80, 0.3, 0.8
THRESHOLD = 0.3
#: Words whose scores a worker remembers; those of LONG letters or more weigh
#: like others but are not remembered.
REMEMBERED, LONG = 300_000, 200
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    """A word's features: itself, its beginnings of 3 to 5 letters, and its
    5-grams between end marks."""
    marked = f"^{word}$"
    return [marked, *({marked[i : i + 5] for i in range(len(marked) - 4)} | {marked[:4] + "*", marked[:5] + "*", marked[:6] + "*"}) - {marked}]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence with a word."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m.group().lower())
        if words:
            out.append((m.start(), m.end(), words))
    return out


def sample(documents: DataFrame, labels: DataFrame, usable: Column, n: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``n`` labelled texts, those whose ids come first by a hash."""
    judged = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
    judged = judged.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = judged.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(n)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") > 0)
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return [(r.text, int(r.toxic)) for r in one.orderBy("doc_id").collect()]


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, shrink: float = SHRINK, bias_rate: float = 0.05, start: float = 400.0) -> tuple[dict[str, float], float]:
    """Feature weights and bias that maximise the noisy-or likelihood."""
    word_no: dict[str, int] = {}
    p_sent, p_word, doc_of, docs_with = array("q"), array("q"), array("q"), {}
    n_sent = 0
    y = np.array([t for _, t in rows], dtype=float)
    for d, (text, _) in enumerate(rows):
        seen: set[int] = set()
        for _, _, words in sentences(text):
            own = {word_no.setdefault(w, len(word_no)) for w in words}
            seen |= own
            p_sent.extend([n_sent] * len(own))
            p_word.extend(own)
            doc_of.append(d)
            n_sent += 1
        for w in seen:
            docs_with[w] = docs_with.get(w, 0) + 1
    if not n_sent or y.min() == y.max():
        return {}, -30.0 if not len(y) or y.max() == 0 else 0.0
    gram_docs: dict[str, int] = {}
    for w, no in word_no.items():
        for g in grams(w):
            gram_docs[g] = gram_docs.get(g, 0) + docs_with[no]
    kept = {g: i for i, g in enumerate(sorted(g for g, n in gram_docs.items() if n >= MIN_DOCS))}
    f_word, f_gram = array("q"), array("q")
    for w, no in word_no.items():
        own = [kept[g] for g in grams(w) if g in kept]
        f_word.extend([no] * len(own))
        f_gram.extend(own)
    f_word, f_gram, p_sent, p_word, doc_of = (np.asarray(a, dtype=np.int64) for a in (f_word, f_gram, p_sent, p_word, doc_of))
    weight, bias = np.zeros(len(kept)), -np.log(start * n_sent / len(rows))
    square, square_b = np.full(len(kept), 1e-6), 1e-6
    shrink = shrink / len(y)
    balance = np.where(y > 0, (y == 0).sum() / max(1, y.sum()), 1.0) / len(y)
    balance[y > 0] = np.minimum(balance[y > 0], 4 / len(y))
    for _ in range(epochs):
        by_word = np.bincount(f_word, weight[f_gram], len(word_no))
        z = bias + np.bincount(p_sent, by_word[p_word], n_sent)
        s = np.bincount(doc_of, np.logaddexp(0, z), len(rows))
        ds = np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-6, 50)), 1.0) * balance
        dz = ds[doc_of] / (1 + np.exp(-z))
        dw = np.bincount(f_gram, np.bincount(p_word, dz[p_sent], len(word_no))[f_word], len(kept))
        square += dw * dw
        weight -= rate * dw / np.sqrt(square)
        weight = np.sign(weight) * np.maximum(np.abs(weight) - rate * shrink / np.sqrt(square), 0)
        square_b += dz.sum() ** 2
        bias -= bias_rate * dz.sum() / np.sqrt(square_b)
    names = sorted(kept)
    return {names[i]: float(weight[i]) for i in np.flatnonzero(np.abs(weight) > 1e-3)}, float(bias)


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        got = self.words.get(w)
        if got is None:
            if len(w) >= LONG:
                return self.long_word(w)
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            got = self.words[w] = sum(self.weights.get(g, 0.0) for g in grams(w))
        return got

    def long_word(self, w: str) -> float:
        """As of other words, but only features that have a weight are held."""
        marked = f"^{w}$"
        parts = chain((marked, *(marked[:n] + "*" for n in (4, 5, 6))), (marked[i : i + 5] for i in range(len(marked) - 4)))
        return sum(self.weights[g] for g in {g for g in parts if g in self.weights})

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or score, and sentences whose own probability is high."""
        if not text:
            return 0.0, []
        word, bias, known = self.word, self.bias, self.words
        clean, spans = 0.0, []
        for m in _SENTENCE.finditer(text):
            words = _WORD.findall(m.group().lower())
            if words:
                z = bias
                for w in set(words):
                    v = known.get(w)
                    z += word(w) if v is None else v
                z = max(-60.0, min(60.0, z))
                clean += log1p(exp(z))
                if z > -0.85:
                    spans.append((m.start(), m.end(), 1 / (1 + exp(-z))))
        return -expm1(-clean), spans


def score(documents: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """doc_id, score, and the offending sentences (start, end, probability) of
    every row, in one narrow stage."""
    weights, bias = model
    key = hashlib.sha256(repr((bias, sorted(weights.items()))).encode()).hexdigest()

    def run(batch: pa.RecordBatch):
        if key not in _SCORERS:  # a reused worker keeps the scorer of one model
            _SCORERS.clear()
            _SCORERS[key] = Scorer(weights, bias)
        scorer = _SCORERS[key]
        got = [scorer(t) for t in batch.column(1).to_pylist()]
        spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in got]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        yield {"doc_id": batch.column(0), "score": pa.array([s for s, _ in got], pa.float64()), "sentences": pa.array(spans, kind)}

    columns = (F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, score double, sentences array<struct<start: int, end: int, probability: double>>"
    return map_batches(documents, columns, run, schema)


_SCORERS: dict[str, Scorer] = {}
