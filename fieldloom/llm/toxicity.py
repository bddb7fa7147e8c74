"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets p = sigmoid(bias + sum of the weights of its distinct words), where a
word weighs what it and its stems (first 4 to 6 letters) weigh, so that inflected forms share what is learnt; the
document's score is the noisy-or 1 - prod(1 - p). Weights are learned from document labels only, by gradient ascent on
the bags' likelihood, and then locate the sentences that offend. Weights are 0 or
more: words make a sentence offend, they don't excuse it.

`fit` learns from at most `max_docs` label rows, those with the smallest hash of their id, and from at most
`max_words` distinct words and stems of them, the ones in most of these documents. Rows with a null label or id don't count;
a null or empty text is a bag without sentences, and scores 0. With no labelled rows the model has no words, and every
sentence scores sigmoid(bias). An empty table stays empty; rows are scored one by one, so repeated ones get equal scores.
Scores read the text column alone; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE, _WORD = re.compile(r"[.!?\n\r\u2026\u3002\uff01\uff1f\u061f\u0964]+"), re.compile(r"\w+")
_NO_LABEL_BIAS = -6.0
_STEMS = range(4, 7)
#: Words whose weight a worker remembers.
_CACHED = 400_000


def sentences(text: str) -> Iterator[str]:
    return (s for s in _SENTENCE.split(text) if s and not s.isspace())


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in _STEMS if len(word) >= k)]


@dataclass
class ToxicityModel:
    bias: float = _NO_LABEL_BIAS
    weights: dict[str, float] = field(default_factory=dict)
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def _weight(self, word: str) -> float:
        if len(self._known) >= _CACHED:
            self._known.clear()
        self._known[word] = w = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def _total(self, found: set[str]) -> float:
        known = self._known
        return math.fsum([known[w] if w in known else self._weight(w) for w in found])

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """One probability for each sentence, in order."""
        z = np.array([self.bias + self._total(words(s)) for s in sentences(text or "")])
        return 1 / (1 + np.exp(-z))

    def judge(self, text: str | None) -> tuple[float, np.ndarray]:
        """The noisy-or of the sentences, and each one's probability."""
        z = np.array([self.bias + self._total(words(s)) for s in sentences(text or "")])
        return float(-np.expm1(-np.logaddexp(0, z).sum())), 1 / (1 + np.exp(-z))


@dataclass
class _Bags:
    """Training documents as numbers: `of_doc` the document of each sentence, `row` and `word` the words of sentences."""

    words: list[str]
    of_doc: np.ndarray
    row: np.ndarray
    word: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, bags: Iterator[tuple[bool, list[str]]]) -> _Bags:
        number: dict[str, int] = {}
        of_doc, row, word, labels = array("i"), array("i"), array("i"), []
        for doc, (label, bag) in enumerate(bags):
            labels.append(label)
            for sentence in bag:
                found = [number.setdefault(w, len(number)) for w in sentence.split("\t") if w]
                row.extend([len(of_doc)] * len(found))
                word.extend(found)
                of_doc.append(doc)
        return cls(list(number), *(np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (of_doc, row, word)), np.array(labels, bool))


def _train(bags: _Bags, max_words: int, min_docs: int, steps: int, ridge: float, lasso: float) -> ToxicityModel:
    labels, n_docs, n_sentences = bags.labels, len(bags.labels), len(bags.of_doc)
    if not n_docs or not labels.any() or labels.all() or not bags.words:
        return ToxicityModel()
    number: dict[str, int] = {}
    parts = [[number.setdefault(f, len(number)) for f in features(w)] for w in bags.words]
    word_of, part = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.fromiter((f for p in parts for f in p), np.int64)
    starts = np.searchsorted(word_of, np.arange(len(parts) + 1))
    # In how many documents of each class a feature is, a few hundred documents at a time.
    doc = bags.of_doc[bags.row]
    count = np.zeros((2, len(number)))
    for lo in range(0, n_docs, 256):
        a, b = np.searchsorted(doc, [lo, lo + 256])
        pairs = np.unique(doc[a:b].astype(np.int64) * len(parts) + bags.word[a:b])
        w = pairs % len(parts)
        sizes = starts[w + 1] - starts[w]
        at = np.repeat(starts[w] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(pairs // len(parts), sizes) * len(number) + part[at])
        for k in (0, 1):
            count[k] += np.bincount(pairs[labels[pairs // len(number)] == k] % len(number), minlength=len(number))
    names = np.array(list(number), object)
    usable = np.flatnonzero(count.sum(0) >= min_docs)
    usable = usable[np.lexsort((names[usable].astype(str), -count.sum(0)[usable]))][:max_words]
    column = np.full(len(number), -1)
    column[usable] = np.arange(len(usable))
    known = column[part] >= 0
    word_of, part, count = word_of[known], column[part[known]], count[:, usable]
    # Start from each feature's smoothed log odds between the classes; the likelihood's ascent then needs few steps.
    w = np.maximum(0, np.log((count[1] + 1) / (labels.sum() + 2)) - np.log((count[0] + 1) / ((~labels).sum() + 2)) - 1)
    bias, m, v = -5.0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        of_word = np.bincount(word_of, w[part], len(bags.words))
        z = bias + np.bincount(bags.row, of_word[bags.word], n_sentences)
        p = 1 / (1 + np.exp(-z))
        safe = np.bincount(bags.of_doc, np.logaddexp(0, z), n_docs)  # -log of the chance that no sentence offends
        share = np.where(labels, 1 / np.maximum(np.expm1(np.minimum(safe, 50)), 1e-9), -1.0)
        g = p * share[bags.of_doc]
        of_word = np.bincount(bags.word, g[bags.row], len(bags.words))
        grad = np.append(np.bincount(part, of_word[word_of], len(w)) - ridge * w, g.sum()) / n_docs
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = np.maximum(0, w + step[:-1] - lasso), bias + step[-1]
    return ToxicityModel(float(bias), {x: float(y) for x, y in zip(names[usable], w, strict=True) if y > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 5_000, max_words: int = 50_000, min_docs: int = 8, steps: int = 150, ridge: float = 0.05, lasso: float = 0.005) -> ToxicityModel:
    """Learns from labels (0 or 1) of documents. max_docs bounds the ids that are broadcast and the words that reach the driver."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_docs)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["_id"].astype(str), "label": b["_label"], "bag": [["\t".join(sorted(words(s))) for s in sentences(t or "")] for t in b["_text"]]})

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _train(_Bags.of((label, bag) for b in batches for label, bag in zip(b["label"], b["bag"], strict=True)), max_words, min_docs, steps, ridge, lasso)
        yield pd.DataFrame({"word": [None, *model.weights], "weight": [model.bias, *model.weights.values()]})

    # The sample, and it alone, is bounded: one task learns from it, and its weights come back.
    sample = rows.mapInPandas(bags, "id string, label boolean, bag array<string>").repartition(1).sortWithinPartitions("id", "label")
    weights = {r["word"]: r["weight"] for r in sample.mapInPandas(trained, "word string, weight double").toLocalIterator()}
    return ToxicityModel(weights.pop(None, _NO_LABEL_BIAS), weights)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score", offending_col: str | None = None, at_least: float = 0.5) -> DataFrame:
    """Adds each document's noisy-or score, and with offending_col the numbers (from 0) of the sentences whose own
    probability reaches at_least."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most max_words words

    def judged(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.judge(t) for t in texts]
        return pd.DataFrame({"score": [f[0] for f in found], "offending": [np.flatnonzero(f[1] >= at_least).astype(np.int32) for f in found]})

    both = F.pandas_udf(judged, "score double, offending array<int>")(F.col(f"`{text_col}`"))
    added = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (out, offending_col)), both.alias("\0judged"))
    names = [F.col(f"`{c}`") for c in df.columns if c not in (out, offending_col)]
    return added.select(*names, F.col("`\0judged`.score").alias(out), *([F.col("`\0judged`.offending").alias(offending_col)] if offending_col else []))


def offending(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """One row for each sentence whose own probability reaches at_least: id, sentence number from 0, text, score."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, float(p)) for i, t in zip(b[id_col], b[text_col], strict=True) for k, (s, p) in enumerate(zip(sentences(t or ""), shared.value.sentence_scores(t), strict=True)) if p >= at_least]
            yield pd.DataFrame(rows, columns=[id_col, "sentence_no", "sentence", "score"])

    return df.select(id_col, text_col).mapInPandas(found, f"`{id_col}` {kind}, sentence_no int, sentence string, score double")
