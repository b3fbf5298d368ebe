"""Edit distance and global alignment of token arrays of any alphabet and length, row by row in Arrow batches.

A row of the dynamic table is one integer with a bit for each token of the second array, so a token of the first
array costs a few operations on all its columns at once. Alignments keep one row in a square root of the first array's
length and compute the rows between two kept ones again on the way back, so memory is the square root of the table's.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "-"


def _places(tokens: list) -> dict:
    """For each token the bits of its places; null equals nothing."""
    out: dict = {}
    for k, t in enumerate(tokens):
        if t is not None:
            out[t] = out.get(t, 0) | 1 << k
    return out


def distance(a: list, b: list) -> int:
    """The least number of insertions, deletions and substitutions between two lists."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places, every, top = _places(b), (1 << len(b)) - 1, 1 << len(b) - 1
    more, less, score = every, 0, len(b)  # columns in which the table rises or falls by one against the one before
    for t in a:
        same = places.get(t, 0)
        x = same | less
        d = (((x & more) + more) ^ more) | x
        rise, fall = less | (every & ~(d | more)), more & d
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 | 1, fall << 1
        more, less = fall & every | (every & ~(x | rise)), rise & x & every
    return score


def alignment(a: list, b: list) -> tuple[int, list, list]:
    """Number of equal pairs and the aligned lists: most pairs; ties go to a pair, then a gap in ``b``, then a gap in ``a``, from the end on."""
    n, m = len(a), len(b)
    places, every = _places(b), (1 << m) - 1
    step = math.isqrt(n) + 1

    def forward(row: int, tokens: list) -> list[int]:
        """Rows after each token; a bit is off where the number of pairs rises."""
        out = []
        for t in tokens:
            hit = row & places.get(t, 0)
            row = ((row + hit) | (row - hit)) & every
            out.append(row)
        return out

    marks, row = [every], every
    for k in range(0, n, step):
        row = forward(row, a[k : k + step])[-1]
        marks.append(row)
    rises = lambda r: ((~r) & every).to_bytes(m // 8 + 1, "little")
    count = lambda r, j: (~r & (1 << j) - 1).bit_count()

    i, j, left, right = n, m, [], []
    total = now = count(row, m)
    while i and j:
        first = (i - 1) // step * step
        rows = [marks[first // step], *forward(marks[first // step], a[first : min(first + step, n)])]
        own = rises(rows[i - first])
        while i > first and j:
            above = rises(rows[i - 1 - first])
            up = count(rows[i - 1 - first], j)
            while j:
                x, y = a[i - 1], b[j - 1]
                side = now - (own[j - 1 >> 3] >> (j - 1 & 7) & 1)
                corner = up - (above[j - 1 >> 3] >> (j - 1 & 7) & 1)
                pair = corner + (x == y)
                if x is not None and y is not None and pair >= up and pair >= side:
                    left.append(x)
                    right.append(y)
                    i, j, now = i - 1, j - 1, corner
                    break
                if up >= side:
                    left.append(x)
                    right.append(GAP)
                    i, now = i - 1, up
                    break
                left.append(GAP)
                right.append(y)
                j, now, up = j - 1, side, corner
            own = above
    left += a[:i][::-1] + [GAP] * j
    right += [GAP] * i + b[:j][::-1]
    return total, left[::-1], right[::-1]


@lru_cache(maxsize=1)
def _distances():
    @F.arrow_udf(T.LongType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    return run


@lru_cache(maxsize=1)
def _alignments():
    words = T.ArrayType(T.StringType())
    kind = pa.struct([("n_match", pa.int32()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))])

    @F.arrow_udf(T.StructType([T.StructField("n_match", T.IntegerType()), T.StructField("a", words), T.StructField("b", words)]))
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            out.append(None if x is None or y is None else dict(zip(("n_match", "a", "b"), alignment(x, y))))
        return pa.array(out, kind)

    return run


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays; null if either is null. Null tokens equal nothing."""
    return _distances()(a, b)


def align(a: Column, b: Column) -> Column:
    """``n_match, a, b``: an alignment of two string arrays with the most equal pairs, gaps ``-``; null if either is null.

    Ties: a pair, then a gap in ``b``, then a gap in ``a``, from the end on. Null tokens are in no pair.
    """
    text = "array<string>"
    return _alignments()(a.cast(text), b.cast(text))
