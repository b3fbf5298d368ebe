"""Quality classifier: Naive Bayes support vectors (NB-SVM).

N-gram indicators of a document (hashed to a fixed number of cells) are scaled by the
log-ratio of their class counts, which cover every labelled training row, and a linear
hinge-loss model is fitted to them by dual coordinate descent on a bounded sample.

Defined results: null or empty text has no indicators and gets the score of the bias;
repeated rows are scored one by one and alike; an empty table gives an empty result; with
no training row of one of the classes every score is the share of label 1 (0.5 without rows).
Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.llm._common import cell_counts, hashed_words, map_text, mix, small_side, text_chunks

#: Hash cells for n-grams.
CELLS = 1 << 18
#: Labelled rows that the hinge-loss model is fitted to, at most (class counts use all rows).
SAMPLE_ROWS = 6000

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 4


class Model(NamedTuple):
    """Weights by cell (already times the log-ratio), log-ratios, bias, and the sigmoid's line."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, cell) pairs of a chunk, sorted by document.

    N-grams: words, word pairs, each word's last three bytes with its case, and pairs of such endings' kinds.
    """
    words = hashed_words(data, bounds)
    if not len(words.doc):
        return words.doc, words.doc
    same = words.doc[1:] == words.doc[:-1]
    pair = mix(words.hash[:-1] * np.uint64(0x100000001B3) + words.hash[1:])[same]
    tail = np.zeros(len(words.doc), dtype=np.uint64)
    kind = np.zeros(len(words.doc), dtype=np.uint64)
    for back in (1, 2, 3):
        at = np.maximum(words.end - back, words.start)
        tail = tail * np.uint64(257) + data[at]
        kind = kind * np.uint64(7) + _KIND[data[at]]
    kind = kind * np.uint64(7) + _KIND[data[words.start]]
    repeat = (words.hash[1:] == words.hash[:-1]).astype(np.uint64)
    kinds = mix((kind[:-1] * np.uint64(2401) + kind[1:]) * np.uint64(2) + repeat + np.uint64(0x5000000))[same]
    doc = np.concatenate([words.doc, words.doc[1:][same], words.doc, words.doc[1:][same]])
    cell = np.concatenate([words.hash, pair, mix(tail + np.uint64(0x3000000)), kinds]) & np.uint64(CELLS - 1)
    key = np.unique(doc.astype(np.uint64) * np.uint64(CELLS) + cell)
    return (key // np.uint64(CELLS)).astype(np.int64), (key % np.uint64(CELLS)).astype(np.int64)


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    """Documents of each label by cell; the cell after the last counts all documents."""
    out = np.zeros((2, CELLS + 1), dtype=np.int64)
    label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
    for first, _, data, bounds in text_chunks(batch.column(0)):
        doc, cell = indicators(data, bounds)
        out += np.bincount(label[first + doc] * (CELLS + 1) + cell, minlength=2 * (CELLS + 1)).reshape(2, -1)
    out[:, CELLS] = np.bincount(label, minlength=2)
    return out


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias by dual coordinate descent over sparse rows (bias as a constant input of 1)."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to label 1, by Newton steps with smoothed targets."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)])

    def loss(t: np.ndarray) -> float:
        z = t @ x
        return float(np.sum(np.logaddexp(0, z) - target * z)) + 1e-6 * float(t @ t)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * theta)
        scale = 1.0
        while scale > 1e-4 and loss(theta - scale * step) > loss(theta):
            scale /= 2
        theta = theta - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    return float(theta[0]), float(theta[1])


def fit(train: DataFrame, text: str = "text", label: str = "label", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit to the rows of ``train``; labels other than 0 and 1 are ignored."""
    rows = train.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(order).alias("o")).where("y in (0, 1)")
    total = cell_counts(rows.select("t", "y"), _counts, 2, CELLS + 1)
    n0, n1 = int(total[0, CELLS]), int(total[1, CELLS])
    empty = np.zeros(CELLS, dtype=np.float32)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(empty, empty, 0.0, 1.0, float(np.log(share / (1 - share))))
    negative, positive = total[0, :CELLS] + 1.0, total[1, :CELLS] + 1.0
    ratios = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    # rows of one id differ by their texts; equal rows are fitted alike
    marked = rows.withColumn("h", F.xxhash64("o", F.lit("sample"), "t"))
    # the bound comes from hashes alone, so that no task takes more than sample_rows texts (and ties at the bound)
    bound = marked.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    picked = marked.where(F.col("h") <= bound).orderBy("h", "o").limit(sample_rows).select("t", "y")

    def make():
        def work(data, bounds):
            doc, cell = indicators(data, bounds)
            cuts = np.searchsorted(doc, np.arange(len(bounds)))
            return {"cells": [cell[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]}

        return work

    got = map_text(picked, make, "cells binary", ["y"], "t").toPandas()
    cells = [np.frombuffer(bytes(c), dtype="<u4").astype(np.int64) for c in got["cells"]]
    values = [(v := ratios[c]) / max(float(np.linalg.norm(v)), 1e-9) for c in cells]
    y = np.where(got["y"].to_numpy() == 1, 1.0, -1.0)
    fold = np.arange(len(y)) % 4
    margin = np.zeros(len(y))
    for k in range(4):
        use = np.flatnonzero(fold != k)
        w, b = dual_descent([cells[i] for i in use], [values[i] for i in use], y[use], CELLS)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[cells[i]] @ values[i] + b
    slope, shift = sigmoid_line(margin, (y > 0).astype(int))
    w, b = dual_descent(cells, values, y, CELLS)
    return Model((w * ratios).astype(np.float32), ratios.astype(np.float32), b, slope, shift)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score``, the probability of label 1, for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three vectors of CELLS entries at most

    def make():
        m = shared.value
        square = m.ratios.astype(np.float64) ** 2

        def work(data, bounds):
            doc, cell = indicators(data, bounds)
            n = len(bounds) - 1
            norm = np.sqrt(np.bincount(doc, square[cell], n))
            margin = np.bincount(doc, m.weights[cell], n) / np.maximum(norm, 1e-9) + m.bias
            return {"score": 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -40, 40)))}

        return work

    return map_text(docs, make, "score double", keep, text)


def classify(docs: DataFrame, labels: DataFrame, is_held_out, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learn from labelled rows that are not held out, score every row."""
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    train = docs.where(~is_held_out).select("doc_id", "text").join(small_side(marks), "doc_id")
    model = fit(train)
    return (
        score(docs.select("doc_id", is_held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
