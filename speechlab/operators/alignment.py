"""Global alignment of token arrays, and reports made from aligned rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlab.operators.sequences import GAP, align, edit_distance  # noqa: F401  (the alignment itself)

def equal_split(phones: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """``start, end``: the time of a run of equal adjacent phones, dealt equally among them, to 0.01 s."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = F.coalesce((F.lag("phone").over(w) != F.col("phone")).cast("long"), F.lit(1))
    runs = phones.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    r = Window.partitionBy(*part, "__run")
    low, width = F.min("start").over(r), (F.max("end").over(r) - F.min("start").over(r)) / F.count("*").over(r)
    k = F.row_number().over(r.orderBy(*order)) - 1

    def hundredths(seconds: Column) -> Column:
        return F.floor(seconds * 100 + 0.5) / 100

    out = runs.withColumn("__s", hundredths(low + k * width)).withColumn("__e", hundredths(low + (k + 1) * width))
    return out.drop("start", "end", "__new", "__run").withColumnRenamed("__s", "start").withColumnRenamed("__e", "end")


def assign_lines(words: DataFrame, lines: DataFrame, part: list[str], order: str, line: str) -> DataFrame:
    """``line`` of each word: the first transcript line whose letters, counted from the start, reach the word's end.

    Both sides are counted and merged in one window over the group, so that no pairs of words and lines are made.
    Words beyond the last line have a null line.
    """

    def counted(df: DataFrame, key: str, text: str) -> Column:
        return F.sum(F.length(text)).over(Window.partitionBy(*part).orderBy(key))

    a = words.select(*part, F.col(order).alias("__o"), F.col("word"), F.lit(None).cast("long").alias("__l"), counted(words, order, "word").alias("__at"))
    b = lines.select(*part, F.lit(None).cast("long").alias("__o"), F.lit(None).cast("string").alias("word"), F.col(line).cast("long").alias("__l"), counted(lines, line, "letters").alias("__at"))
    # from the end to the start: a frame that only grows is walked through once, one that shrinks is read again for every row
    back = Window.partitionBy(*part).orderBy(F.desc("__at"), F.col("__l").isNotNull().desc(), F.desc("__o"), F.desc("__l")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = a.unionByName(b).withColumn(line, F.last("__l", ignorenulls=True).over(back))
    return merged.where(F.col("__o").isNotNull()).select(*part, F.col("__o").alias(order), "word", line)


def cut_table(words: DataFrame, phrases: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Bounds and share of marked words of each phrase; phrases never met have ``detected`` false."""
    seen = words.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg((F.col("word") == mark).cast("double")).alias("mismatch"), F.lit(True).alias("seen"))
    return phrases.select(*keys).distinct().join(seen, keys, "left").withColumn("detected", F.coalesce("seen", F.lit(False))).drop("seen")


def chunk_groups(scores: Column, counts: Column) -> Column:
    """Scores grouped by the counts of their chunks."""
    bounds = F.transform(counts, lambda c, i: F.struct((F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda s, x: s + x.cast("int")) + 1).alias("at"), c.cast("int").alias("n")))
    return F.transform(bounds, lambda x: F.slice(scores, x["at"], x["n"]))


def compounds(parts: DataFrame, key: list[str], order: str) -> DataFrame:
    """``phones`` of a compound: every combination of its parts' ``alternatives`` (an array), the last part changing fastest."""
    rows = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "alternatives"))), lambda x: x["alternatives"]).alias("p"))

    def widen(done: Column, more: Column) -> Column:
        return F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.concat_ws("_", d, m))))

    folded = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.element_at("p", 1), widen)
    return rows.select(*key, F.posexplode(folded).alias("alt_idx", "phones"))


def spelled(words: DataFrame, letters: DataFrame) -> DataFrame:
    """``word, phones`` of acronyms: the last alternative of each letter's name; words with an unknown letter go."""
    last = letters.groupBy("letter").agg(F.max_by("phones", "alt_idx").alias("name"))
    each = words.select("word").distinct().select("word", F.posexplode(F.split("word", "")).alias("i", "letter"))
    told = each.join(F.broadcast(last), "letter", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("s"))
    return told.where(~F.exists("s", lambda x: x["name"].isNull())).select("word", F.array_join(F.transform("s", lambda x: x["name"]), "_").alias("phones"))


#: Training rows up to which every task reads them all, and rows of either side that meet in a task beyond.
MOST_TRAINING, GROUP_ROWS = 200_000, 50_000


def _nearest(x: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, training row and distance of the ``k`` nearest to each row of ``x``: exact, ties to the smaller id."""
    own, other = (x * x).sum(1), (train * train).sum(1)
    about = own[:, None] + other[None, :] - 2 * (x @ train.T)
    most = np.partition(about, k - 1, axis=1)[:, k - 1] if k < len(train) else np.full(len(x), np.inf)
    # products round, so all that may be among the nearest are measured by their differences
    row, col = np.nonzero(about <= (most + 1e-11 * (own + other.max(initial=0)))[:, None])
    far = np.concatenate([np.zeros(0), *(np.sqrt(((x[row[j : j + 65536]] - train[col[j : j + 65536]]) ** 2).sum(1)) for j in range(0, len(row), 65536))])
    order = np.lexsort((ids[col], far, row))
    row, col, far = row[order], col[order], far[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], far[kept]


def _blocks_of(t: np.ndarray) -> int:
    """Rows whose distances to all of ``t`` are held at once."""
    return max(1, (1 << 20) // max(1, len(t)))


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _near_all(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """``id, label, d`` of the neighbours of each row, from a training set that every task reads."""
    rows = train.toArrow()
    shared = train.sparkSession.sparkContext.broadcast((_vectors(rows.column("v")), rows.column("id").to_numpy(), rows.column("label").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, own, labels = shared.value
        for batch in batches:
            for j in range(0, batch.num_rows if len(t) else 0, _blocks_of(t)):
                part = batch.slice(j, _blocks_of(t))
                row, col, far = _nearest(_vectors(part.column(1)), t, own, k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), labels.take(pa.array(col)), pa.array(far)], names=["id", "label", "d"])

    kind, label = test.schema["id"].dataType.simpleString(), train.schema["label"].dataType.simpleString()
    return test.mapInArrow(run, f"id {kind}, label {label}, d double")


def _near_in_groups(train: DataFrame, test: DataFrame, k: int, group_rows: int) -> DataFrame:
    """The same from a training set of any size: both sides are dealt to groups, every pair of groups meets in a task, and the best are merged.

    A task holds ``group_rows`` rows of either side, about; of each row it gives its ``k`` best in the group.
    """
    kind, label = test.schema["id"].dataType.simpleString(), train.schema["label"].dataType.simpleString()
    own_kind = train.schema["id"].dataType.simpleString()
    n, m = (max(1, -(-x.count() // group_rows)) for x in (train, test))
    dealt = lambda groups: F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = train.select(dealt(n).alias("g"), every(m).alias("h"), "id", "label", "v")
    right = test.select(every(n).alias("g"), F.col("id"), "v").select("g", dealt(m).alias("h"), "id", "v")

    def meet(t: pa.Table, x: pa.Table) -> pa.Table:
        vectors, own, labels = _vectors(t.column("v")), t.column("id").to_numpy(), t.column("label").combine_chunks()
        ids, x = x.column("id").combine_chunks(), _vectors(x.column("v"))
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for j in range(0, len(x) if len(own) else 0, _blocks_of(own)):
            row, col, far = _nearest(x[j : j + _blocks_of(own)], vectors, own, k)
            found.append((row + j, col, far))
        row, col, far = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([ids.take(pa.array(row)), pa.array(own[col]), labels.take(pa.array(col)), pa.array(far)], names=["id", "tid", "label", "d"])

    best = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, f"id {kind}, tid {own_kind}, label {label}, d double")
    merged = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "tid", "label"))), 1, k).alias("e"))
    return merged.select("id", F.explode("e").alias("e")).select("id", "e.label", "e.d")


def knn_probabilities(train: DataFrame, test: DataFrame, k: int, metric: str = "euclidean", weights: str = "distance", most_training: int = MOST_TRAINING, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id, label, p``: shares of the ``k`` nearest training rows' labels.

    metric: euclidean or cosine (1 minus the cosine: half the squared distance of the vectors at length 1; a vector of zeros
    stays); weights: distance (1 / distance) or uniform. A training set (id, label, v) of up to ``most_training`` rows is read by
    every task, a larger one is dealt to groups. Neighbours are exact, ties go to the smaller id. If a neighbour is at distance
    zero, only such ones count, unless weights are uniform. Rows whose ``v`` is null or not all finite are left out; test ids are distinct.
    """
    if metric == "cosine":
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
        unit = F.when(size > 0, F.transform("v", lambda c: c.cast("double") / size)).otherwise(F.col("v").cast("array<double>"))
        train, test = train.withColumn("v", unit), test.withColumn("v", unit)
    elif metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    train = train.select("id", "label", F.col("v").cast("array<double>").alias("v")).where(_finite("v"))
    test = test.select("id", F.col("v").cast("array<double>").alias("v")).where(_finite("v"))
    small = train.limit(most_training + 1).count() <= most_training
    near = _near_all(train, test, k) if small else _near_in_groups(train, test, k, group_rows)
    if metric == "cosine":
        near = near.withColumn("d", F.col("d") * F.col("d") / 2)
    if weights == "uniform":
        counts = near.groupBy("id", "label").agg(F.count("*").alias("n"))
        return counts.select("id", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("p"))
    votes = near.groupBy("id", "label").agg(F.sum(F.when(F.col("d") > 0, 1 / F.nullif("d", F.lit(0.0)))).alias("far"), F.count_if(F.col("d") == 0).cast("double").alias("same"))
    of = Window.partitionBy("id")
    weighed = votes.withColumn("w", F.when(F.max("same").over(of) > 0, F.col("same")).otherwise(F.col("far")))
    return weighed.withColumn("p", F.col("w") / F.sum("w").over(of)).where("w > 0").select("id", "label", "p")


def _finite(v: str) -> Column:
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
