"""Quality classifier: a factorisation machine.

Features: hashed words (each 1 / sqrt of how many there are), bins of statistics of the text's structure, and of its
length (metadata taken from the text itself).  score = sigmoid(b + sum w x + pairwise interactions), the
interactions of low rank, in linear time by the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.
It is fitted on the driver to at most ``PER_CLASS`` labelled documents of each label, of at most ``LONGEST`` characters each,
weighted to their true shares, and sent to the executors; scoring reads whole texts.

The score depends on the text alone.  Rows whose crc32(doc_id) mod 5 is 0 are never learned from.

Edge cases: a null text counts as empty, which is scored by its structure alone; without labels of both kinds
all scores are that of the untrained model; texts are scored whole, however long; a score of just the threshold is label 1; repeated rows each get a row; a null doc_id is not held out;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, own_columns, split_of

MODULUS, HELD = 5, 0
THRESHOLD = 0.3
PER_CLASS, LONGEST = 3000, 20_000
BITS, RANK, BINS = 14, 8, 10
#: Passes over the sample, and steps that are made at least.
EPOCHS, STEPS, BATCH, RATE, DECAY = 10, 500, 64, 0.02, 1e-3
REMEMBERED = 500_000
STATS = ("words", "distinct", "again", "mean_length", "capitals", "symbols", "bars", "marks", "digits", "lines", "same_lines", "ends", "not_ascii", "long_words")
SIZE = (1 << BITS) + len(STATS) * BINS


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """``STATS`` of one text."""
    n, size = max(len(words), 1), max(len(text), 1)
    less = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    return [
        math.log1p(len(words)), len(set(words)) / n, same, sum(map(len, words)) / n, less(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), less(b"#*$%&<>@^~="), less(b"|"), less(b"!?"),
        less(b"0123456789"), len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1), less(b".,;:"), less(bytes(range(128, 256))), sum(len(w) > 20 for w in words) / n,
    ]


class Model:
    def __init__(self, edges: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.edges, self.bias, self.w, self.v = edges, bias, w, v
        self.known: dict[bytes, int] = {}

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the features of a text."""
        words = text.split()
        known = self.known
        ids = []
        for x in words:
            i = known.get(x)
            if i is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                i = known[x] = zlib.crc32(x.lower()) >> (32 - BITS)
            ids.append(i)
        index = np.unique(np.array(ids, np.int64))
        stats = statistics(text, words)
        bins = [(1 << BITS) + k * BINS + int(np.searchsorted(self.edges[k], s, side="right")) for k, s in enumerate(stats)]
        values = np.concatenate([np.full(len(index), 1 / math.sqrt(max(len(index), 1))), np.full(len(bins), 1 / math.sqrt(len(bins)))])
        return np.concatenate([index, np.array(bins, np.int64)]), values

    def score(self, text: bytes) -> float:
        index, x = self.vector(text)
        vx = self.v[index] * x[:, None]
        s = vx.sum(0)
        z = self.bias + float(self.w[index] @ x) + 0.5 * float(s @ s - (vx * vx).sum())
        return 1 / (1 + math.exp(-max(min(z, 40.0), -40.0)))


def train(sample: list[tuple[str, int]], positive_share: float = 0.5) -> Model:
    """Fits the model; ``positive_share`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(11)
    labels = np.array([y for _, y in sample], np.float64)
    share = min(max(positive_share, 0.01), 0.99)
    edges = np.zeros((len(STATS), BINS - 1))
    model = Model(edges, math.log(share / (1 - share)), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    if len(set(labels.tolist())) < 2:
        model.v[:] = 0
        return model
    texts = [(t or "").encode() for t, _ in sample]
    stats = np.array([statistics(t, t.split()) for t in texts])
    # Half of the edges from each label, so that what sets the fewer apart gets bins of its own.
    low, high = ([np.quantile(stats[labels == y], q, axis=0) for q in qs] for y, qs in ((0, (0.05, 0.25, 0.5, 0.75)), (1, (0.02, 0.1, 0.5, 0.9, 0.98))))
    edges[:] = np.sort(np.array([*low, *high]).T, axis=1)
    rows = [model.vector(t) for t in texts]
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    seen = np.bincount(np.concatenate([i for i, _ in rows]), minlength=SIZE)
    mw, sw, mv, sv, t = np.zeros(SIZE), np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros((SIZE, RANK)), 0
    epochs = max(EPOCHS, math.ceil(STEPS * BATCH / len(rows)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            index = np.concatenate([rows[d][0] for d in own])
            x = np.concatenate([rows[d][1] for d in own])
            lengths = [len(rows[d][0]) for d in own]
            row = np.repeat(np.arange(len(own)), lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = model.v[index] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = model.bias + np.add.reduceat(model.w[index] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = weight[own] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[own]) / len(own)
            gx = g[row] * x
            gw = np.bincount(index, gx, SIZE) + DECAY / len(own) * model.w
            each = gx[:, None] * (s[row] - vx)
            gv = np.stack([np.bincount(index, each[:, f], SIZE) for f in range(RANK)], axis=1) + DECAY / len(own) * model.v
            t += 1
            for p, grad, m1, m2 in ((model.w, gw, mw, sw), (model.v, gv, mv, sv)):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
            model.bias -= 2 * rate * float(g.sum())
    model.w[seen < 2] = 0
    model.v[seen < 2] = 0
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = own_columns(labels, ("doc_id", "quality")).where(F.col("quality").isin(0, 1) & (split_of(F.col("doc_id"), MODULUS) != HELD))
    share = known.agg(F.avg("quality")).first()[0]
    return train(labelled_sample(docs, labels, "quality", MODULUS, HELD, PER_CLASS, LONGEST), 0.5 if share is None else share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.bias, model.w.astype(np.float32), model.v.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(t.as_py() or b"") for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    out = own_columns(docs, ("doc_id", "text")).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id bigint, score double")
    held = (split_of(F.col("doc_id"), MODULUS) == HELD).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
