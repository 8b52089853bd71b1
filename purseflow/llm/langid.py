"""Language identification by averaged hashed subword embeddings.

A text's features are its words and their runs of 3 and 4 bytes with the word's
edges, hashed to BUCKETS rows of an embedding table. A text is the mean of its
features' embeddings, and a linear softmax gives the languages' shares. Both are
trained by stochastic gradient descent in numpy. A temperature and a threshold for
rejection are set on sampled documents that training hasn't seen.

As the softmax is linear, a bucket's embedding is multiplied with it once, so a text
needs one look-up a feature. Only fitting uses a sample: PER_LANGUAGE documents of at
most SAMPLED_BYTES bytes of each language, whole, and fewer of each if there are so many
languages that they would be over SAMPLED_DOCS. Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm.common import bounded_sample, fold
from purseflow.llm.ngrams import Words, batches

PER_LANGUAGE = 600
SAMPLED_DOCS = 240_000  # of all languages
SAMPLED_BYTES = 1 << 16  # longer texts are not drawn for fitting
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
GRAMS = (3, 4)
ACCEPTED = 0.995  # of the unseen documents that are predicted well, rejection keeps this share
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a bucket's logits
    bias: np.ndarray
    temperature: float
    threshold: float


def _buckets(words: Words):
    """Bucket and text number of every feature."""
    yield (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(words.begins, words.start, "right") - 1
    for n in GRAMS:
        h, at = words.grams(n)
        yield (h & np.uint64(BUCKETS - 1)).astype(np.int64), np.clip(np.searchsorted(words.begins, at, "right") - 1, 0, len(words.begins) - 2)


def _sums(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the features' rows and the number of features, for each text."""
    k = table.shape[1]
    total, n = np.zeros((len(texts), k)), np.zeros(len(texts))
    for index, group in batches(texts):
        words = Words(group)
        for bucket, text in _buckets(words):
            if not len(bucket):
                continue
            place = index[text]
            n += np.bincount(place, minlength=len(texts))
            for j in range(k):
                total[:, j] += np.bincount(place, table[bucket, j], minlength=len(texts))
    return total, n


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _logits(model: LanguageModel, texts: list[str | None]) -> np.ndarray:
    total, n = _sums(texts, model.table)
    return total / np.maximum(n, 1)[:, None] + model.bias


def train(texts: list[str], langs: list[str], seed: int = 5) -> LanguageModel:
    """Stochastic gradient descent over three of four texts, calibration on the others."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    unseen, seen = order[: len(texts) // 4], order[len(texts) // 4 :]
    bags = []
    for t in texts:
        found = np.concatenate([b for _, group in batches([t]) for b, _ in _buckets(Words(group))] or [np.zeros(0, np.int64)])
        bags.append(np.unique(found, return_counts=True))
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(seen):
            bucket, count = bags[i]
            if not len(bucket):
                continue
            share = count / count.sum()
            mean = share @ e[bucket]
            off = _softmax(mean @ w + bias)
            off[y[i]] -= 1
            back = w @ off
            w -= rate * np.outer(mean, off)
            bias -= 0.1 * rate * off
            e[bucket] -= 50 * rate * share[:, None] * back
    model = LanguageModel(languages, np.ascontiguousarray(e @ w), bias, 1.0, 0.0)
    if len(unseen):
        raw = _logits(model, [texts[i] for i in unseen])
        choice = np.geomspace(0.02, 5, 60)
        loss = [-np.log(_softmax(raw / t)[np.arange(len(unseen)), y[unseen]] + 1e-12).mean() for t in choice]
        model.temperature = float(choice[int(np.argmin(loss))])
        p = _softmax(raw / model.temperature)
        right = p.argmax(axis=1) == y[unseen]
        if right.any():
            model.threshold = float(np.quantile(p.max(axis=1)[right], 1 - ACCEPTED))
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learn from text and non-null lang of rows whose fold isn't held out; None if there is no such row."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    known = known.where(F.octet_length("text") <= SAMPLED_BYTES)
    languages = known.select("lang").distinct().count()
    rows = bounded_sample(known, "doc_id", "lang", max(1, min(per_language, SAMPLED_DOCS // max(1, languages)))).collect()
    rows = sorted((r for r in rows if any(map(str.isalpha, r.text))), key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def _predict(shared):
    def run(batches_):
        model: LanguageModel | None = shared.value
        for b in batches_:
            texts = b.column("text").to_pylist()
            pred, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if model is not None and texts:
                p = _softmax(_logits(model, texts) / model.temperature)
                best = p.argmax(axis=1)
                for i, t in enumerate(texts):
                    if t is not None and any(map(str.isalpha, t)):
                        pred[i], score[i] = model.languages[best[i]], min(1.0, p[i, best[i]])
                        rejected[i] = p[i, best[i]] < model.threshold
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row and its whole text. ``rejected``
    says that the calibrated score is below the threshold, as for a text in no known
    language; lang_pred then still is the nearest. Null texts and texts without a
    letter get ``und`` and score 0, and so does everything without a model. Of languages
    that are as likely, the first by name is taken. Repeated rows come back repeated, an
    empty table gives an empty one, and other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")
