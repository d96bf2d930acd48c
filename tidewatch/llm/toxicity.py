"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's logit is a bias plus the weights of its words and of their beginnings
(hashed); a document's score is the noisy-or of its sentences, 1 - product of (1 - p).  Only document labels are used:
the gradient of the document's likelihood gives each sentence its share, so the model finds the
offending sentences by itself.  It is fitted on the driver to at most ``PER_CLASS`` labelled documents of each label,
each of at most ``LONGEST`` characters, and sent to the executors; scoring reads whole texts.

The score depends on the text alone.  Rows whose crc32(doc_id) mod 4 is 2 are never learned from.

Edge cases: a null or empty text has the score 0 and no offending sentence; without labels of both kinds all scores are that of the
untrained model; texts are scored whole, however long; of sentences equally bad the first is the worst; repeated rows each get a row; a null doc_id is not held out; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, own_columns, split_of

MODULUS, HELD = 4, 2
THRESHOLD = 0.3
PER_CLASS, LONGEST = 2500, 20_000
BITS = 17
BEGINNINGS = (4, 5, 6, 7)
EPOCHS, BATCH, RATE, DECAY = 5, 64, 0.02, 1e-3
#: A feature must be in so many of the sampled documents.
LEAST = 3
#: Longer sentences are cut into pieces of so many words; smaller weights are dropped.
PIECE, PRUNED = 25, 0.2
#: Standard errors by which the log odds of a feature are lowered to begin with.
SURE = 1.5
REMEMBERED = 400_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
OUT = "score double, worst_start bigint, worst_end bigint, worst_score double, n_offending bigint"


def features(word: str) -> list[int]:
    whole = [zlib.crc32(word.encode()) >> (32 - BITS)]
    return whole + [zlib.crc32(f"{k}^{word[:k]}".encode()) >> (32 - BITS) for k in BEGINNINGS if len(word) > k]


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = float(self.weights[features(word)].sum())
        return got

    def score(self, text: str) -> tuple[float, int | None, int | None, float | None, int]:
        """Of the document; then start, end (code points) and score of its worst sentence, and how many pass the threshold."""
        total, worst, at, offending = 0.0, -math.inf, (None, None), 0
        known, word, bias = self.known, self.word, self.bias
        for m in SENTENCE.finditer(text):
            words = WORD.findall(m[0].lower())
            if not words:
                continue
            top = -math.inf
            for k in range(0, len(words), PIECE):
                z = bias
                for w in set(words[k : k + PIECE]):
                    v = known.get(w)
                    z += word(w) if v is None else v
                total += math.log1p(math.exp(z)) if z < 30 else z
                top = max(top, z)
            offending += top > -0.8473  # logit of the threshold
            if top > worst:
                worst, at = top, m.span()
        if at[0] is None:
            return 0.0, None, None, None, 0
        return -math.expm1(-total), at[0], at[1], 1 / (1 + math.exp(-max(min(worst, 50.0), -50.0))), offending


def train(sample: list[tuple[str, int]]) -> Model:
    """Fits the model to (text, label) pairs by gradient steps on the noisy-or likelihood."""
    weights, bias = np.zeros(1 << BITS), -8.0
    ids: dict[str, np.ndarray] = {}
    feats, sents, docs, lengths = [], [], [], []
    found = np.zeros((2, 1 << BITS), np.int32)  # documents of each label that have a feature
    n_sent = 0
    for d, (text, y) in enumerate(sample):
        own = []
        for m in SENTENCE.finditer(text or ""):
            every = WORD.findall(m[0].lower())
            for k in range(0, len(every), PIECE):
                words = set(every[k : k + PIECE])
                for w in words:
                    if w not in ids:
                        ids[w] = np.array(features(w), np.int32)
                x = np.concatenate([ids[w] for w in words])
                own.append(x)
                lengths.append(len(x))
                docs.append(d)
                n_sent += 1
        if own:
            both = np.concatenate(own)
            feats.append(both)
            found[int(y), np.unique(both)] += 1
    labels = np.array([y for _, y in sample])
    if n_sent == 0 or len(set(labels.tolist())) < 2:
        return Model(weights, bias)
    count = found.sum(0)
    # To begin with, what each feature surely tells: the lower bound of its log odds.
    odds = [np.log((found[y] + 0.5) / ((labels == y).sum() + 1)) for y in (0, 1)]
    weights = np.maximum(0, odds[1] - odds[0] - SURE * np.sqrt(1 / (found[1] + 0.5) + 1 / (found[0] + 0.5))) * (count >= LEAST)
    feat = np.concatenate(feats)
    sents = np.repeat(np.arange(n_sent, dtype=np.int32), lengths)
    use = count[feat] >= LEAST
    feat, sents, doc_of = feat[use], sents[use], np.array(docs, np.int32)
    first_feat = np.searchsorted(sents, np.searchsorted(doc_of, np.arange(len(sample) + 1)))
    first_sent = np.searchsorted(doc_of, np.arange(len(sample) + 1))
    m1, m2, mb, vb, t = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(sample))
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            f = np.concatenate([feat[first_feat[d] : first_feat[d + 1]] for d in own])
            spans = [np.arange(first_sent[d], first_sent[d + 1]) for d in own]
            s_all = np.concatenate(spans)
            if not len(s_all):
                continue
            place = np.zeros(n_sent, np.int32) if t == 0 else place  # noqa: F821
            place[s_all] = np.arange(len(s_all))
            s = place[np.concatenate([sents[first_feat[d] : first_feat[d + 1]] for d in own])]
            bag = np.repeat(np.arange(len(own)), [len(x) for x in spans])
            z = bias + np.bincount(s, weights[f], len(s_all))
            total = np.bincount(bag, np.logaddexp(0, z), len(own))
            y = labels[own]
            pull = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
            g = np.clip(pull, -20, 1)[bag] / (1 + np.exp(-z)) / len(own)
            grad = np.bincount(f, g[s], len(weights)) + DECAY / len(own) * weights
            t += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            weights -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
            gb = g.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            bias -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights[(count < LEAST) | (np.abs(weights) < PRUNED)] = 0
    return Model(weights.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_sample(docs, labels, "toxic", MODULUS, HELD, PER_CLASS, LONGEST))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence's place and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            got = [own.score(t.as_py() or "") for t in b.column(1)]
            cols = [pa.array(c, kind) for c, kind in zip(zip(*got) if got else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "score", "worst_start", "worst_end", "worst_score", "n_offending"])

    out = own_columns(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id bigint, {OUT}")
    held = (split_of(F.col("doc_id"), MODULUS) == HELD).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score", "n_offending")
