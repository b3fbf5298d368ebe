"""Exact top-k search: a Voronoi kNN join for integer inner products.

Inner products become distances by one more component: with M the largest squared norm of the
data, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M - 2 q.x, so that
the nearest x' are the highest products. Pivots, picked from the data by hash, split queries
and data into cells. Each cell has a summary: the largest query distance to the pivot, and
the k smallest and the largest data distance. From these summaries and the pivots' distances
follows a bound on the k-th distance of every query of a cell; a data row is replicated to a
query cell only if the triangle inequality does not put it beyond that bound. Rows travel packed
in blocks of bounded size, sorted by distance. Query cells that lie near each other form a family, dealt to as many groups as its
queries need, and the blocks of a data cell are dealt to groups likewise; a data block goes to the groups of those families
only of which some cell's bound it reaches. A join key is a pair of groups, so that neither a hot cell nor the number of
pivots bounds the number of tasks or their size; each pair of blocks is solved locally; a task's running best lists
are bounded in number and merged by query id.

Defined results: vectors that are null or hold a null or non-finite component, or of another
length than the commonest, take no part; rows that repeat an id and a vector count once; ties
go to the smaller id; a query has fewer rows if there are fewer candidates; empty tables give
an empty result. Extra columns are ignored. Bounds are widened by a relative 1e-6, so rounding
never drops a row; scores are exact as long as they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlab.llm._common import stored

#: Pivots (bounded, so cell tables are), rows of a block of queries and of data.
PIVOTS, QUERY_BLOCK, DATA_BLOCK = 48, 256, 256
#: Blocks that meet in one task at most, about: of queries, and of one data cell. Beyond it they are dealt over several keys.
TASK_QUERIES, TASK_DATA = 1024, 128
#: Best entries that a task holds at once; beyond it they go on, to be merged later.
HELD = 2_000_000


def quantised(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 64) -> DataFrame:
    """``id, v``: floor(scale * component) of every vector without null or non-finite component; repeated rows once."""
    x = F.col(vector)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).dropDuplicates(["id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _packed(rows: DataFrame, pivots: np.ndarray, top: float, query: bool, size: int) -> DataFrame:
    """Blocks ``cell, ids, vectors, distances, n, far`` (``far``: the largest distance) of at most ``size`` rows, sorted by distance to the pivot in a cell's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            v = _matrix(batch.column(1))
            f = v.astype(np.float64)
            norm = (f * f).sum(1)
            last = np.zeros(len(f)) if query else np.sqrt(np.maximum(top - norm, 0))
            f = np.concatenate([f, last[:, None]], axis=1)
            far = np.maximum((f * f).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * f @ pivots.T, 0)
            cell = far.argmin(1)
            dist = np.sqrt(far[np.arange(len(f)), cell])
            order = np.lexsort((dist, cell))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
            out: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                for c in range(a, b, size):
                    pick = order[c : min(c + size, b)]
                    out.append((int(cell[pick[0]]), ids[pick].astype("<i8").tobytes(), v[pick].astype("<i8").tobytes(), dist[pick].astype("<f8").tobytes(), len(pick), float(dist[pick[-1]])))
            names = ["cell", "ids", "vectors", "distances", "n", "far"]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "cell int, ids binary, vectors binary, distances binary, n int, far double")


def _summary(blocks: DataFrame, k: int) -> dict[int, tuple[float, np.ndarray]]:
    """For each cell the largest distance and the k smallest ones: at most PIVOTS * k numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[int, float] = {}
        near: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(d, dtype="<f8")
                far[cell] = max(far.get(cell, 0.0), float(x.max()))
                near[cell] = np.sort(np.concatenate([near.get(cell, x[:0]), x]))[:k]
        rows = [(c, far[c], near[c].tolist()) for c in far]
        kinds = [pa.int32(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["cell", "far", "near"])

    parts = blocks.select("cell", "distances").mapInArrow(run, "cell int, far double, near array<double>")
    far = {r["cell"]: r["far"] for r in parts.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    least = parts.select("cell", F.explode("near").alias("d")).groupBy("cell", F.pmod(F.hash("d"), F.lit(16)).alias("s"))
    least = least.agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d")).groupBy("cell")
    near = {r["cell"]: np.array(r["d"]) for r in least.agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d")).collect()}
    return {c: (far[c], near[c]) for c in far}


def reach(queries: dict, data: dict, pivots: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``(query cell, data cell, least pivot distance)``: data rows nearer to their pivot cannot be needed.

    A query of cell i is at most far_i + |p_i p_j| + d from a row at distance d of cell j's pivot, so the
    k-th smallest of these sums bounds its k-th distance (one more row, as the query's own does not count);
    and it is at least |p_i p_j| - far_i - d away.
    """
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0))
    out = []
    for i, (far, _) in queries.items():
        sums = np.sort(np.concatenate([far + gap[i, j] + near for j, (_, near) in data.items()]))
        bound = float(sums[k - 1]) if len(sums) >= k else float("inf")
        bound = bound * (1 + 1e-6) + 1e-6
        for j, (widest, _) in data.items():
            least = gap[i, j] - far - bound
            if widest * (1 + 1e-6) + 1e-6 >= least:
                out.append((i, j, float(least)))
    return out


def families(blocks: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """``{query cell: (family, groups of the family)}``: cells along a chain of nearest pivots, together up to ``most`` blocks.

    A cell of more blocks is a family of its own, dealt to several groups.
    """
    left, chain = set(blocks), []
    while left:
        gap = (lambda c: float(((pivots[c] - pivots[chain[-1]]) ** 2).sum())) if chain else (lambda c: 0.0)
        chain.append(min(left, key=lambda c: (gap(c), c)))
        left.remove(chain[-1])
    sets: list[list[int]] = []
    for c in chain:
        if sets and sum(blocks[x] for x in sets[-1]) + blocks[c] <= most:
            sets[-1].append(c)
        else:
            sets.append([c])
    return {c: (f, -(-sum(blocks[x] for x in own) // most)) for f, own in enumerate(sets) for c in own}


def sent(blocks: DataFrame, pairs: list[tuple[int, int, float]], dealt: dict[int, tuple[int, int]], parts: dict[int, int]) -> DataFrame:
    """``other, ids, vectors, distances, dg, family, qg``: data blocks, once for each group of each family that can need them.

    parts: the groups of each data cell.
    """
    least: dict[tuple[int, int], float] = {}
    for i, j, bound in pairs:
        at = j, dealt[i][0]
        least[at] = min(least.get(at, bound), bound)
    groups = dict(dealt.values())
    rows = [(j, f, bound, groups[f], parts[j]) for (j, f), bound in least.items()]  # at most pivots * pivots rows
    needs = blocks.sparkSession.createDataFrame(rows, "other int, family int, least double, groups int, nd int")
    out = blocks.withColumnRenamed("cell", "other").join(F.broadcast(needs), "other").where(F.col("far") * (1 + 1e-6) + 1e-6 >= F.col("least"))
    dg = F.pmod(F.xxhash64("ids"), F.col("nd")).cast("int").alias("dg")
    return out.select("other", "ids", "vectors", "distances", dg, "family", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("qg"))


def _merge(best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: higher score first, then smaller id."""
    q, s, x = best
    order = np.lexsort((x, -s, q))
    q, s, x = q[order], s[order], x[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = rank < k
    return q[keep], s[keep], x[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave 53 bits, else in 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def top_k(data: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, task_queries: int = TASK_QUERIES, task_data: int = TASK_DATA) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` highest products among other ids' rows."""
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    width = data.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], schema)
    dim = int(width["w"])
    data = stored(data.where(F.size("v") == dim), "data")
    queries = stored(queries.where(F.size("v") == dim), "queries")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    top = data.agg(F.max(norm)).first()[0]
    picked = data.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if top is None or not picked:
        return spark.createDataFrame([], schema)
    centre = np.array([r["v"] for r in picked], dtype=np.float64)
    centre = np.concatenate([centre, np.sqrt(np.maximum(top - (centre * centre).sum(1), 0))[:, None]], axis=1)
    left = stored(_packed(queries, centre, top, True, QUERY_BLOCK), "query-blocks").withColumn("block", F.monotonically_increasing_id())
    right = stored(_packed(data, centre, top, False, DATA_BLOCK), "data-blocks")
    pairs = reach(_summary(left, 1), _summary(right, k + 1), centre, k + 1)
    if not pairs:
        return spark.createDataFrame([], schema)
    sizes = {r["cell"]: r["n"] for r in right.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most pivots rows
    parts = {c: -(-n // task_data) for c, n in sizes.items()}
    counts = {r["cell"]: r["n"] for r in left.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most pivots rows
    dealt = families(counts, centre, task_queries)
    # a query block goes to every group of the data cells near it, a data block to the groups of queries that can need it
    near = spark.createDataFrame([(i, j, least, parts[j], *dealt[i]) for i, j, least in pairs], "cell int, other int, least double, nd int, family int, groups int")  # at most pivots * pivots rows
    left = left.select("cell", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    plan = left.join(F.broadcast(near), "cell").withColumn("qg", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int"))
    plan = plan.select("block", "q_ids", "q", "other", "least", "family", "qg", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("dg"))
    right = sent(right, pairs, dealt, parts)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in best.values()])) for c in range(3)], names=["query_id", "score", "vec_id"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, q_ids, q, least, ids, vectors, distances = (batch.column(c)[i].as_py() for c in range(7))
                keep = np.frombuffer(distances, "<f8") * (1 + 1e-6) + 1e-6 >= least
                a, b = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")[keep]
                if not len(b):
                    continue
                score = products(np.frombuffer(q, "<i8").reshape(-1, dim), np.frombuffer(vectors, "<i8").reshape(-1, dim)[keep])
                other = a[:, None] != b[None, :]
                nth = max(0, len(b) - k)
                floor = np.partition(np.where(other, score, np.iinfo(np.int64).min), nth, axis=1)[:, nth]
                row, col = np.nonzero(other & (score >= floor[:, None]))
                new = (a[row], score[row, col], b[col])
                old = best.get(block)
                held -= len(old[0]) if old else 0
                best[block] = _merge(tuple(np.concatenate(x) for x in zip(old, new)) if old else new, k)
                held += len(best[block][0])
                if held > HELD:
                    yield out()
                    best, held = {}, 0
        if best:
            yield out()

    joined = plan.join(right, ["other", "dg", "family", "qg"]).select("block", "q_ids", "q", "least", "ids", "vectors", "distances")
    # a query block's pairs may lie in several tasks: each gives its k best, which meet below
    local = joined.mapInArrow(solve, "query_id long, score long, vec_id long")
    return merged(local, k)


def merged(local: DataFrame, k: int) -> DataFrame:
    """The k best of each query id among local best rows, by a bounded array for each id."""
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("x"))
    part = local.groupBy("query_id", F.pmod(F.hash("vec_id"), F.lit(8)).alias("salt")).agg(F.array_sort(F.collect_set(entry)).alias("e"))
    part = part.select("query_id", F.slice("e", 1, k).alias("e"))
    full = part.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    rows = full.select("query_id", F.posexplode(F.slice("e", 1, k)).alias("i", "e"))
    return rows.select(
        "query_id",
        (F.col("i") + 1).cast(T.IntegerType()).alias("rank"),
        F.col("e.x").alias("vec_id"),
        (-F.col("e.s")).alias("score"),
    )
