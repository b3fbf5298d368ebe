"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads a document's bytes, blanks included, in both directions, labels every byte
position with language probabilities, and a document pools the probabilities of all its positions
(their mean). So that positions of one document can be read side by side, a text is dealt into
windows of ``CORE`` bytes; each direction enters a window ``CONTEXT`` bytes before it, so a position
is labelled from up to ``CORE + CONTEXT`` bytes on either side and never from less than ``CONTEXT``
(or what the document has); beyond a document's ends the network reads a boundary symbol.
Training is numpy: backpropagation through time over windows of a bounded sample.

Defined results: null text or text without a letter is ``und`` with score 0; repeated rows are
labelled alike; equal pooled probabilities go to the first language in sorted order; an empty
table gives an empty result; without a training row every document with a letter is ``und`` too.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.llm._common import map_text, text_chunks

UNDETERMINED = "und"
CORE, CONTEXT, HIDDEN = 96, 16, 16
#: The symbol beyond a document's ends, after the 256 bytes.
BOUNDARY, SYMBOLS = 256, 257
#: Bounds of training: documents a language, windows a document, steps a window, windows in all (at least LEAST_WINDOWS a language).
SAMPLE_DOCS, DOC_WINDOWS, STEPS, SAMPLE_WINDOWS, LEAST_WINDOWS = 250, 12, 64, 8_000, 32
#: Languages that a model learns at most, the most frequent ones of its rows: a column of other things than languages stays bounded.
LANGUAGES = 500
#: Bytes of text that are dealt into windows together, and windows that the network reads side by side.
CHUNK_BYTES, BLOCK = 1 << 18, 1024


class Model(NamedTuple):
    """Languages in order, and the weights: per direction input (with bias) and recurrent, then the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + abs(x)): the network's bounded function, in place of tanh, and a third of its time."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def _gates(w: dict[str, np.ndarray], way: str, symbols: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a direction: update and reset gates, the recurrent part of the candidate, the candidate, the new state."""
    inp = w[way + "x"][symbols]
    hid = own @ w[way + "h"]
    both = (1 + squash(inp[:, : 2 * HIDDEN] + hid[:, : 2 * HIDDEN])) / 2
    z, r, part = both[:, :HIDDEN], both[:, HIDDEN:], hid[:, 2 * HIDDEN :]
    c = squash(inp[:, 2 * HIDDEN :] + r * part)
    return z, r, part, c, own + z * (c - own)


class _Direction:
    """One direction's weights for reading only: gates and candidate apart, and the halves of the gates taken out of the sums."""

    def __init__(self, w: dict[str, np.ndarray], way: str):
        x, h = w[way + "x"].astype(np.float32), w[way + "h"].astype(np.float32)
        cut = 2 * HIDDEN
        self.tables = [np.ascontiguousarray(m) for m in (x[:, :HIDDEN], x[:, HIDDEN:cut], x[:, cut:])]
        self.hidden = [np.ascontiguousarray(m) for m in (h[:, :HIDDEN], h[:, HIDDEN:cut], h[:, cut:] * np.float32(0.5))]

    def step(self, symbols: np.ndarray, own: np.ndarray) -> np.ndarray:
        z, r, inp = (np.take(t, symbols, axis=0) for t in self.tables)
        uz, ur, c = (own @ h for h in self.hidden)
        z += uz
        r += ur
        r = squash(r)
        r += 1
        c *= r
        c += inp
        c = squash(c)
        c -= own
        c *= np.float32(0.5)
        z = squash(z)
        z += 1
        c *= z
        c += own
        return c


def forward(w: dict[str, np.ndarray], way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, windows, units) of one direction over whole windows ``x`` (windows, steps), and the tape."""
    n, steps = x.shape
    own = np.zeros((n, HIDDEN), dtype=w[way + "h"].dtype)
    out, tape = np.zeros((steps, n, HIDDEN), dtype=own.dtype), [None] * steps
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z, r, part, c, new = _gates(w, way, x[:, t], own)
        tape[t] = (own, z, r, part, c)
        out[t] = own = new
    return out, tape


def backward(w: dict[str, np.ndarray], way: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Backpropagation through time: adds the gradients of one direction's weights, given those of its states."""
    dh = np.zeros_like(dout[0])
    inputs = np.zeros((x.shape[1], x.shape[0], 3 * HIDDEN), dtype=dout.dtype)
    for t in range(x.shape[1] - 1, -1, -1) if way == "f" else range(x.shape[1]):
        own, z, r, part, c = tape[t]
        dn = dh + dout[t]
        # the squashed y of x has the slope (1 - abs(y))^2, and a gate is half of 1 + y
        dz, dc = dn * (c - own) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, dn * z * (1 - np.abs(c)) ** 2
        dr, dpart = dc * part * 0.5 * (1 - np.abs(2 * r - 1)) ** 2, dc * r
        inputs[t] = np.concatenate([dz, dr, dc], axis=1)
        back = np.concatenate([dz, dr, dpart], axis=1)
        grad[way + "h"] += own.T @ back
        dh = dn - dn * z + back @ w[way + "h"].T
    order = np.argsort(x.T.ravel(), kind="stable")
    symbols, first = np.unique(x.T.ravel()[order], return_index=True)
    grad[way + "x"][symbols] += np.add.reduceat(inputs.reshape(-1, 3 * HIDDEN)[order], first, axis=0)


def loss_and_gradients(w: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of the windows ``x`` inside documents, and its gradients."""
    hf, tf = forward(w, "f", x)
    hb, tb = forward(w, "b", x)
    both = np.concatenate([hf, hb], axis=2)
    logit = both @ w["o"] + w["ob"]
    p = np.exp(logit - logit.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    live = (x.T != BOUNDARY).astype(p.dtype)
    live /= max(live.sum(), 1)
    rows = np.arange(len(x))
    loss = float(-(np.log(np.maximum(p[:, rows, target], 1e-12)) * live).sum())
    p[:, rows, target] -= 1
    p *= live[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["o"] = both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2])
    grad["ob"] = p.sum((0, 1))
    dboth = p @ w["o"].T
    backward(w, "f", x, tf, dboth[:, :, :HIDDEN], grad)
    backward(w, "b", x, tb, dboth[:, :, HIDDEN:], grad)
    return loss, grad


def initial(n_languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w: dict[str, np.ndarray] = {}
    for way in "fb":
        w[way + "x"] = rng.normal(0, 0.3, (SYMBOLS, 3 * HIDDEN)).astype(np.float32)
        w[way + "h"] = rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
    w["o"] = rng.normal(0, 0.2, (2 * HIDDEN, n_languages)).astype(np.float32)
    w["ob"] = np.zeros(n_languages, dtype=np.float32)
    return w


def train(x: np.ndarray, target: np.ndarray, n_languages: int, epochs: int = 4, batch: int = 128, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights fitted to windows of one language each: cross-entropy at every position, Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    w = initial(n_languages, rng)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    steps = max(1, epochs * -(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            pick = order[a : a + batch]
            _, grad = loss_and_gradients(w, x[pick], target[pick])
            step += 1
            rate = 0.01 * (1 - 0.9 * step / steps)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and length of each window of a chunk."""
    parts = (np.diff(bounds) + CORE - 1) // CORE
    doc = np.repeat(np.arange(len(parts)), parts)
    start = bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * CORE
    return doc, start, np.minimum(bounds[1:][doc] - start, CORE)


def position_sums(w: dict[str, np.ndarray], data: np.ndarray, bounds: np.ndarray, most: int = BLOCK) -> np.ndarray:
    """For each document of a chunk the summed language probabilities of all its byte positions."""
    k = len(w["ob"])
    doc, start, length = windows(bounds)
    out, directions = np.zeros((len(bounds) - 1, k)), {way: _Direction(w, way) for way in "fb"}
    order = np.argsort(-length, kind="stable")  # the longest first, so that windows that have ended are the last rows
    block = max(64, min(most, (1 << 21) // (CORE * k)))
    for a in range(0, len(order), block):
        pick = order[a : a + block]
        d, s, l = doc[pick], start[pick], length[pick]
        active = np.searchsorted(-l, -np.arange(CORE), "left")  # windows longer than t
        logits = np.zeros((CORE, len(pick), k), dtype=np.float32)
        sums = np.zeros((len(pick), k), dtype=np.float32)
        row = np.arange(len(pick))
        for way in "fb":
            own, step = np.zeros((len(pick), HIDDEN), dtype=np.float32), directions[way].step
            for t in range(-CONTEXT, int(l[0])):
                n = len(pick) if t < 0 else int(active[t])
                at = s[:n] + t if way == "f" else s[:n] + l[:n] - 1 - t
                if t < 0:
                    inside = (at >= bounds[d]) & (at < bounds[d + 1])
                    symbols = np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.int64), BOUNDARY)
                else:
                    symbols = data[at]
                own = step(symbols, own[:n])
                if t < 0:
                    continue
                if way == "f":
                    logits[t, :n] = own @ w["o"][:HIDDEN]
                else:
                    logit = logits[l[:n] - 1 - t, row[:n]]
                    logit += own @ w["o"][HIDDEN:]
                    logit += w["ob"]
                    logit -= logit.max(1, keepdims=True)
                    np.exp(logit, out=logit)
                    sums[:n] += logit / logit.sum(1, keepdims=True)
        for j in range(k):
            out[:, j] += np.bincount(d, sums[:, j], len(out))
    return out


def _cut(data: np.ndarray, bounds: np.ndarray) -> dict[str, list[bytes]]:
    """Up to DOC_WINDOWS training windows of each document, evenly spread, as 16-bit symbols."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = min(DOC_WINDOWS, -(-(b - a) // STEPS))
        first = a + np.linspace(-4, max(b - a - STEPS + 4, -4), n).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        at = first[:, None] + np.arange(STEPS)[None, :]
        inside = (at >= a) & (at < b)
        own = data[np.clip(at, a, b - 1)].astype(np.int64) if n else at
        out.append(np.where(inside, own, BOUNDARY).astype("<u2").tobytes())
    return {"cut": out}


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> Model:
    """Fit to windows of about ``sample_docs`` texts of each language (of the ``languages`` most frequent), picked by a hash of ``order``."""
    known = rows.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(order).alias("o")).where("t <> '' and l is not null")
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(languages).collect()}
    if not counts:
        return Model([], {})
    # a hash bound for each language keeps about sample_docs of its rows; no sort and no window over all rows
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, sample_docs / n) * (1 << 20)) + 1))])
    picked = known.where(F.pmod(F.xxhash64("o", F.lit("lang")), F.lit(1 << 20)) < F.try_element_at(share, F.col("l")))
    cuts = map_text(picked, lambda: _cut, "cut binary", ["l"], "t").toArrow()  # about sample_docs * DOC_WINDOWS * STEPS symbols a language
    parts = [np.frombuffer(c.as_buffer(), dtype="<u2").reshape(-1, STEPS) for c in cuts.column("cut")]
    labels = cuts.column("l").to_pylist()
    names = sorted(set(labels))
    number = {v: i for i, v in enumerate(names)}
    x = np.concatenate(parts) if parts else np.zeros((0, STEPS), dtype="<u2")
    target = np.repeat([number[v] for v in labels], [len(p) for p in parts]).astype(np.int64)
    if not len(x):
        return Model([], {})
    x = x.astype(np.int64)
    keys = np.lexsort(x.T[::-1])  # the order of rows does not decide what is learned
    x, target = x[keys], target[keys]
    rng = np.random.default_rng(5)
    most = max(LEAST_WINDOWS, SAMPLE_WINDOWS // len(names))
    pick = []
    for i in range(len(names)):
        own = np.flatnonzero(target == i)
        own = rng.permutation(own)[:most]
        pick.append(own[np.arange(most) % len(own)] if 0 < len(own) else own)  # each language weighs the same
    pick = np.concatenate(pick)
    return Model(names, train(x[pick], target[pick], len(names)))


def predictions(docs: DataFrame, model: Model, text: str = "text"):
    """A column ``struct<best: int, pooled: double>`` for ``docs``: only the text goes to Python, the other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in columns:
            best, score = [np.zeros(0, dtype=np.int32)], [np.zeros(0)]
            for _, _, data, bounds in text_chunks(column, CHUNK_BYTES):
                pooled = position_sums(m.weights, data, bounds) / np.maximum(np.diff(bounds), 1)[:, None]
                best.append(pooled.argmax(1).astype(np.int32))
                score.append(np.clip(pooled.max(1), 0, 1))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(best)), pa.array(np.concatenate(score))], names=["best", "pooled"])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not deterministic for the optimizer: a filter on the result is not computed apart from it
    return F.arrow_udf(run, "best int, pooled double").asNondeterministic()(F.col(text))


def label(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` (its pooled probability) for every whole text."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = F.array(*[F.lit(v) for v in model.languages])
    out = docs.select(*keep, letter.alias("__letter"), predictions(docs, model, text).alias("__p"))
    return out.select(
        *keep,
        F.when(F.col("__letter"), F.get(names, F.col("__p.best"))).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(F.col("__letter"), F.col("__p.pooled")).otherwise(F.lit(0.0)).alias("score"),
    )
