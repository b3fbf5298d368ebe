"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel draws without replacement.

Prefix CRCs: a text's words are lower-cased and joined by single spaces, and the document is scanned once, storing the
running CRC-32 (without its first and last inversions) where words begin and end. CRC is linear over GF(2), so the CRC of the bytes
from a to b is ``prefix(b) ^ shift(prefix(a), b - a)``: the earlier prefix is moved over the n-gram's length
(multiplication by x^8 for each byte, by powers of two, from tables) and cancels. Every n-gram costs two look-ups, whatever its
length.

Feature counts are summed by bucket, a table of a fixed size. The draw ranks all documents by range: dealt in order of the
score over partitions that are stored, with the number of rows before each partition.

Defined results: null text has no words: no features, weight 0. Repeated rows and ids stay rows of their own;
equal scores are ranked by id, then null ids first, then by place. Empty tables give no rows (an empty target has T = 0).
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.llm._common import CHUNK_BYTES, cell_counts, stored
from speechlab.operators.ordered import positions

#: Fixed value: the CRC-32 polynomial, bits in reverse.
POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
#: ASCII letters in lower case, ASCII digits and bytes beyond ASCII as they are, all else a space.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """``[k, j, v]``: byte j of a CRC, of value v, moved over 2^k zero bytes; 48 powers."""
    basis = np.array([1 << i for i in range(32)], dtype=np.uint32)
    for _ in range(8):  # over one byte
        basis = (basis >> np.uint32(1)) ^ np.where(basis & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    out = np.zeros((48, 4, 256), dtype=np.uint32)
    values = np.arange(256)
    for k in range(len(out)):
        for j in range(4):
            for bit in range(8):
                out[k, j] ^= np.where(values >> bit & 1, basis[8 * j + bit], np.uint32(0)).astype(np.uint32)
        basis = _move(basis, out[k])
    return out


def _move(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][crc >> np.uint32(8) & np.uint32(255)] ^ table[2][crc >> np.uint32(16) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC moved over its number of zero bytes."""
    out, tables = crc.astype(np.uint32, copy=True), _shifts()
    for k in range(int(size.max(initial=0)).bit_length()):
        own = np.flatnonzero(size >> k & 1)
        out[own] = _move(out[own], tables[k])
    return out


class Prefixes:
    """Running CRCs of documents at the bounds of their words, from one scan of each."""

    def __init__(self, texts: list[bytes]):
        place, ends, sizes = [0], [], []
        for text in texts:
            words = text.translate(_FOLD).split()
            place.append(place[-1] + len(words))
            # one more space stands before the first word; _ONES going in and coming out undo the library's inversions
            ends += accumulate(words, lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c)), initial=int(_ONES))
            sizes += map(len, words)
        self.place, self.size = np.array(place), np.array(sizes, dtype=np.int64)
        running = np.array(ends, dtype=np.uint32) ^ _ONES
        before = np.ones(len(running), dtype=bool)  # all but each document's last
        before[self.place[1:] + np.arange(len(texts))] = False
        after = np.ones(len(running), dtype=bool)  # all but each document's first
        after[self.place[:-1] + np.arange(len(texts))] = False
        self.end = running[after]
        self.start = shift(running[before], np.ones(len(self.size), dtype=np.int64)) ^ np.uint32(zlib.crc32(b" ", int(_ONES)) ^ int(_ONES))
        self.reach = np.cumsum(self.size + 1)

    def features(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """``(document, crc)`` of all runs of 1 to ``longest`` words."""
        document = np.repeat(np.arange(len(self.place) - 1), np.diff(self.place))
        documents, found = [], []
        for n in range(1, longest + 1):
            last = np.arange(n - 1, len(document))
            head = last - (n - 1)
            within = document[head] == document[last]
            head, last = head[within], last[within]
            size = self.reach[last] - self.reach[head] + self.size[head]
            raw = self.end[last] ^ shift(self.start[head], size)
            found.append(raw ^ shift(np.full(len(size), _ONES), size) ^ _ONES)
            documents.append(document[head])
        return np.concatenate(documents), np.concatenate(found)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about ``CHUNK_BYTES``, with the first row's number."""
    at, held, size = 0, [], 0
    for k, t in enumerate(column.cast(pa.large_binary())):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def bucket_counts(df: DataFrame, longest: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def work(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((1, buckets), dtype=np.int64)
        for _, texts in _texts(batch.column(0)):
            out[0] += np.bincount(Prefixes(texts).features(longest)[1].astype(np.int64) % buckets, minlength=buckets)
        return out

    return cell_counts(df.select(F.col(text).cast("string")), work, 1, buckets)[0]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, target: DataFrame, longest: int, buckets: int, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words, n_features, weight``."""
    gain = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _texts(batch.column(batch.num_columns - 1)):
                prefixes = Prefixes(texts)
                document, crc = prefixes.features(longest)
                n = np.bincount(document, minlength=len(texts))
                # sums of integers below 2^53 are exact
                weight = np.bincount(document, weights=gain[crc.astype(np.int64) % buckets], minlength=len(texts)).astype(np.int64)
                kept = batch.slice(at, len(texts)).select(names)
                cols = [*kept.columns, pa.array(np.diff(prefixes.place), pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "n_features", "weight"])

    kept = docs.drop(text)
    names = kept.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return docs.select(*names, F.col(text).cast("string")).mapInArrow(run, f"{fields}n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: Gumbel-top-k over the documents of at least ``least_words`` words.

    ``rank`` is null for documents that are not among the ``percent`` of highest scores.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = weighed(narrow, target.select(F.col(text).alias("text")), longest, buckets)
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), F.monotonically_increasing_id().alias("place"))
    scored = stored(scored.withColumn("short", F.col("n_words") < least_words), "scores")
    n = scored.where("not short").count() * percent // 100
    placed = positions(scored, ["short", F.desc("score"), "doc_id", "place"])
    rank = F.when(~F.col("short") & (F.col("position") <= n), F.col("position"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
