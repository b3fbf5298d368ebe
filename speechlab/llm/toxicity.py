"""Toxicity: maximum-scoring segments over token log-odds.

Each token has the log-ratio of its document counts in toxic and other training rows under
Dirichlet priors (hashed to a fixed number of cells, counted over all labelled training rows);
a longer token takes the best of its own ratio and those of its first 4, 5 and 6 bytes, so
that unseen forms of a toxic stem count.
Minus a drift, these scores make the expected token negative, so that a linear-time scan
finds every maximal-scoring segment (each segment that no extension or cut improves).
Segments are judged by extreme-value statistics: E = K n exp(-lambda S), with lambda from
the scores of tokens of clean training rows and K from the best segments of clean rows.
A document's score is a logistic curve over the summed evidence of its significant segments.

Defined results: null or empty text has no segment and the score of no evidence; repeated
rows are scored alike; an empty table gives an empty result; without training rows of both
labels every score is the share of label 1, and there are no segments. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.llm._common import BLANKS, FOLD_ASCII, Words, cell_counts, hashed_words, map_text, mix, small_side, text_chunks
from speechlab.llm.quality import sigmoid_line

CELLS = 1 << 20
#: Labelled rows that the statistics of segments (K and the curve) are fitted to, at most.
SAMPLE_ROWS = 20000
PRIOR, Z_LEAST, DRIFT, CAP = 2000.0, 3.0, 1.0, 6.0
#: Root of the deviance from which a token of few documents counts: four toxic ones and no other at a share of 0.13.
ROOT_LEAST = 4.0
#: Segments with a smaller E are significant.
E_MOST = 0.5

#: Bytes of ASCII that belong to no word: all but letters, digits and the bytes of other scripts.
SEPARATORS = BLANKS.copy()
SEPARATORS[:128] = True
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = False


#: Lengths in bytes of the beginnings that back a token up.
STEMS = (4, 5, 6)


def cells(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a chunk, and for each its cell and those of its stems (its own again where it is not longer)."""
    words = hashed_words(data, bounds, SEPARATORS)
    keys = [words.hash]
    if len(words.doc):
        length, stem = words.end - words.start, np.zeros(len(words.doc), dtype=np.uint64)
        for k in range(max(STEMS)):
            stem = stem * np.uint64(257) + FOLD_ASCII[data[np.minimum(words.start + k, words.end - 1)]]
            if k + 1 in STEMS:
                keys.append(np.where(length > k + 1, mix(stem + np.uint64((k + 1) << 56)), words.hash))
    return words, (np.stack(keys) & np.uint64(CELLS - 1)).astype(np.int64)


class Model(NamedTuple):
    """Token scores by cell, lambda, ln K, and the curve from evidence to probability."""

    scores: np.ndarray
    lam: float
    log_k: float
    slope: float
    shift: float


def segments(position: np.ndarray, value: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment ``(first token, end token, score)`` in one linear scan.

    position, value: of the tokens with a positive score; total: sums of all scores before each token.
    The candidate list holds left and right sums; a new token joins the nearest earlier candidate
    with a smaller left sum if that one's right sum is below its own, else it stands alone. Each
    candidate links to the nearest earlier one with a smaller left sum: what a search passes over
    lies between a candidate and its link and is not looked at again, so the scan is linear.
    """
    first: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []
    for p, v in zip(position.tolist(), value.tolist()):
        a, low, high = p, float(total[p]), float(total[p]) + v
        j = len(left) - 1
        while j >= 0 and left[j] >= low:
            j = link[j]
        while j >= 0 and right[j] < high:
            a, low, before = first[j], left[j], link[j]
            del first[j:], end[j:], left[j:], right[j:], link[j:]
            j = before
        first.append(a)
        end.append(p + 1)
        left.append(low)
        right.append(high)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(first, end, left, right)]


def _class_counts(batch: pa.RecordBatch) -> np.ndarray:
    """Documents of each label by cell; the cell after the last counts all documents."""
    out = np.zeros((2, CELLS + 1), dtype=np.int64)
    label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
    for first, _, data, bounds in text_chunks(batch.column(0)):
        words, keys = cells(data, bounds)
        key = np.unique(words.doc[None, :] * CELLS + keys)
        doc, cell = key // CELLS, key % CELLS
        out += np.bincount(label[first + doc] * (CELLS + 1) + cell, minlength=2 * (CELLS + 1)).reshape(2, -1)
    out[:, CELLS] = np.bincount(label, minlength=2)
    return out


def token_scores(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds of counts with Dirichlet priors in proportion to all counts, cut where not significant, minus the drift.

    Significant is a ratio of ``Z_LEAST`` deviations, or, as the prior outweighs tokens of few documents, a signed root of the
    deviance from the classes' shares of ``ROOT_LEAST``.
    """
    every = clean + toxic
    prior = PRIOR * every / every.sum() + 0.01
    n0, n1, a = clean.sum(), toxic.sum(), prior.sum()
    odds = np.log((toxic + prior) / (n1 + a - toxic - prior)) - np.log((clean + prior) / (n0 + a - clean - prior))
    z = odds / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    expected = every * (toxic.sum() / every.sum())
    parts = [np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(e, 1e-300)), 0.0) for n, e in ((toxic, expected), (clean, every - expected))]
    root = np.where(toxic > expected, np.sqrt(2 * np.maximum(parts[0] + parts[1], 0)), 0.0)
    return (np.where((z >= Z_LEAST) | (root >= ROOT_LEAST), np.clip(odds, 0, CAP), 0.0) - DRIFT).astype(np.float32)


def found(scores: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Token counts of a chunk's documents, and their segments."""
    words, keys = cells(data, bounds)
    n = len(bounds) - 1
    value = scores[keys].max(0).astype(np.float64)
    cuts = np.searchsorted(words.doc, np.arange(n + 1))
    up = np.flatnonzero(value > 0)
    edges = np.searchsorted(up, cuts)
    out: list[list[tuple[int, int, float]]] = []
    for d in range(n):
        if edges[d] == edges[d + 1]:
            out.append([])
            continue
        own = value[cuts[d] : cuts[d + 1]]
        at = up[edges[d] : edges[d + 1]] - cuts[d]
        total = np.concatenate([[0.0], np.cumsum(own)])
        out.append(segments(at, own[at], total))
    return np.diff(cuts), out


def evidence(length: int, segs: list[tuple[int, int, float]], lam: float, log_k: float) -> float:
    """Summed lambda S - ln(K n) - ln(E limit) of significant segments; 0 without one."""
    base = log_k + np.log(max(length, 1)) - np.log(E_MOST)
    return float(sum(max(0.0, lam * s - base) for _, _, s in segs))


def _lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(weight * exp(lambda * score)) = 1, by bisection; 1 if no score is positive."""
    p = weight / weight.sum()
    use = p > 0
    s, p = scores[use].astype(np.float64), p[use]
    if not (s > 0).any():
        return 1.0
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(mid * s)) < 1 else (low, mid)
    return low


def fit(train: DataFrame, text: str = "text", label: str = "label", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = train.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(order).alias("o")).where("y in (0, 1)")
    total = cell_counts(rows.select("t", "y"), _class_counts, 2, CELLS + 1)
    n0, n1 = int(total[0, CELLS]), int(total[1, CELLS])
    if not n0 or not n1 or not total[:, :CELLS].any():
        share = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.full(CELLS, -DRIFT, dtype=np.float32), 1.0, 0.0, 1.0, float(np.log(share / (1 - share))))
    clean, toxic = total[0, :CELLS].astype(float), total[1, :CELLS].astype(float)
    scores = token_scores(clean, toxic)
    lam = _lambda(scores, clean)
    shared = train.sparkSession.sparkContext.broadcast(scores)  # CELLS entries
    picked = rows.select("t", "y", F.xxhash64("o", F.lit("segments")).alias("h"))
    # the share of rows whose hash is below the bound, about sample_rows of them: no sort, no text moved
    share = min(1.0, sample_rows / (n0 + n1))
    picked = picked.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def make():
        def work(data, bounds):
            length, segs = found(shared.value, data, bounds)
            best = [[s for _, _, s in x] for x in segs]
            return {"n": length.astype(np.int64), "best": pa.array(best, pa.list_(pa.float64()))}

        return work

    got = map_text(picked, make, "n bigint, best array<double>", ["y"], "t").toPandas()
    y, n = got["y"].to_numpy(), np.maximum(got["n"].to_numpy(), 1)
    top = np.array([max(b, default=0.0) for b in got["best"]])
    calm = (y == 0) & (top > 0)
    log_k = float(np.mean(lam * top[calm] - np.log(n[calm])) + np.euler_gamma * -1.0) if calm.any() else float(-np.log(n.mean()))
    x = np.array([evidence(k, [(0, 0, s) for s in b], lam, log_k) for k, b in zip(n, got["best"])])
    slope, shift = sigmoid_line(x, y)
    return Model(scores, lam, log_k, slope, shift)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``segments`` (token bounds, score and E of each significant segment) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS entries

    def make():
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e", pa.float64())]))

        def work(data, bounds):
            length, segs = found(m.scores, data, bounds)
            x = np.array([evidence(k, s, m.lam, m.log_k) for k, s in zip(length, segs)])
            out = []
            for k, own in zip(length, segs):
                es = [(a, b, s, float(np.exp(np.clip(m.log_k + np.log(max(k, 1)) - m.lam * s, -700, 700)))) for a, b, s in own]
                out.append([{"first": a, "end": b, "score": s, "e": e} for a, b, s, e in es if e < E_MOST])
            return {"score": 1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -40, 40))), "segments": pa.array(out, kind)}

        return work

    return map_text(docs, make, "score double, segments array<struct<first: bigint, end: bigint, score: double, e: double>>", keep, text)


def classify(docs: DataFrame, labels: DataFrame, is_held_out, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, segments``: learn from labelled rows that are not held out, score every row."""
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    train = docs.where(~is_held_out).select("doc_id", "text").join(small_side(marks), "doc_id")
    model = fit(train)
    return (
        score(docs.select("doc_id", is_held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
        .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")
    )
