"""Helpers shared by the corpus operators: stored tables, checked broadcasts, hashed words.

Everything here is bounded by one Arrow batch, one stored table or a fixed number of
hash cells; nothing gathers the corpus.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only up to this many (narrow) rows; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows of one key that a shuffle join may meet in a task; keys with more are broadcast.
HOT_ROWS = 20_000
#: Bytes of text that the vectorised helpers look at together (a longer document is one chunk).
CHUNK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent a temporary folder is made and set, but only if driver and executors are one machine.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unmarked (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` inner-joined to ``counted`` (one row for each key, whose rows it counts in ``n``) without a hot task.

    Keys of more than ``hot`` rows are few: at most the rows divided by ``hot``. They are broadcast if their number
    is small, so their rows stay where they are; the other keys are shuffled, at most ``hot`` rows of a key.
    """
    hot_keys = counted.where(F.col(n) > hot)
    if not hot_keys.limit(1).count():
        return rows.join(counted, keys)
    broad = small_side(hot_keys)
    mild = rows.join(small_side(hot_keys.select(*keys)), keys, "left_anti").join(counted.where(F.col(n) <= hot), keys)
    return rows.join(broad, keys).unionByName(mild)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores at its end until no taken name (in any case) equals it."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id's text leaves ``remainder``; a null id is never held out."""
    rest = F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(rest == F.lit(remainder), F.lit(False))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Words(NamedTuple):
    """Words of a chunk: row in the chunk, byte bounds, and a 64-bit hash of the bytes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


#: Positions that are hashed together; powers beyond are products of two tables.
_BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier, and of its inverse, below ``_BLOCK``: tables of a fixed size."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    out = []
    for factor in (_MULTIPLIER, inverse):
        p = np.full(_BLOCK, np.uint64(factor), dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of each run of bytes, from sums over blocks of positions."""
    power, inverse = _powers()
    from_sum, to_sum = np.zeros(len(start), dtype=np.uint64), np.zeros(len(end), dtype=np.uint64)
    total = np.uint64(0)
    for k in range(0, len(low), _BLOCK):
        part = low[k : k + _BLOCK]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        sums *= np.uint64(pow(_MULTIPLIER, k, 1 << 64))
        sums += total
        total = sums[-1]
        for at, out in ((start, from_sum), (end, to_sum)):
            a, b = np.searchsorted(at, k, "left"), np.searchsorted(at, k + len(part), "right")
            out[a:b] = sums[at[a:b] - k]
    back = inverse[start & (_BLOCK - 1)]
    if len(low) > _BLOCK:
        far = np.array([pow(_MULTIPLIER, -k * _BLOCK, 1 << 64) for k in range(len(low) // _BLOCK + 1)], dtype=np.uint64)
        back = back * far[start // _BLOCK]
    return mix((to_sum - from_sum) * back + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FOLD_ASCII = np.arange(256, dtype=np.uint8)
FOLD_ASCII[65:91] += 32
KEEP_CASE = np.arange(256, dtype=np.uint8)
#: Space and \t \n \v \f \r separate words.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, bounds)`` for runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def hashed_words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = BLANKS, fold: np.ndarray = FOLD_ASCII) -> Words:
    """Maximal runs of bytes that are no separators, never across documents, hashed after folding."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    low = fold[data]
    inside = ~separator[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    begins[filled] = inside[filled]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(bounds, start, "right") - 1, start, end, _hashes(low, start, end))


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]],
    schema: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of ``df`` beside what ``make()(bytes, bounds)`` gives for each row's text.

    ``make`` is called once in each task; its function gets a chunk of whole texts.
    """

    names = keep if text in keep else [*keep, "__text"]  # the text is sent once, also where it is kept
    where = names.index(text) if text in keep else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for first, end, data, bounds in text_chunks(batch.column(where)):
                kept = batch.slice(first, end - first).select(keep)
                new = work(data, bounds)
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v) for v in new.values())], names=[*keep, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    sent = df.select(*keep) if text in keep else df.select(*keep, F.col(text).alias("__text"))
    return sent.mapInArrow(run, f"{fields}, {schema}")


def cell_counts(df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], kinds: int, cells: int) -> np.ndarray:
    """The sums (kinds, cells) over all batches of ``work(batch)``, an int64 array of that fixed size.

    A task adds up its batches and emits the cells it has met; Spark adds those, and at most
    ``cells`` rows come to the driver, once.
    """
    columns = [f"c{k}" for k in range(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kinds, cells), dtype=np.int64)
        for batch in batches:
            total += work(batch)
        met = np.flatnonzero(total.any(axis=0))
        for a in range(0, len(met), 1 << 16):
            own = met[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(total[k, own]) for k in range(kinds))], names=["cell", *columns])

    parts = df.mapInArrow(run, "cell int, " + ", ".join(f"{c} long" for c in columns))
    table = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((kinds, cells), dtype=np.int64)
    at = table.column("cell").to_numpy()
    for k, c in enumerate(columns):
        out[k, at] = table.column(c).to_numpy()
    return out
