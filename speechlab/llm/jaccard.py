"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity of 0.8 or more.

Sets that are equal are one class (a 64-bit hash of the set), so copies are never paired. In a set
of n shingles ordered from rare to frequent (by a count sketch over all documents, then by hash),
two linked sets share a shingle within their first n - ceil(0.8 n) + 1, and K within K - 1 more.
Token-combination prefixes: rare shingles of the prefix are indexed one by one. Frequent shingles
(sketch counts far above the mean) are dealt to G groups by hash, in a prefix extended by G: if no
rare shingle is shared there, G + 1 frequent ones are, two of them in one group, so pairs within
a group are indexed. G is a twentieth of the size class (of ratio 1.3; each set is indexed under
its own class and the next, linked sets so meet in one). Sets of under 20 shingles have G = 0 and
are indexed by single frequent shingles. Below 77 percent classes are wider (``class_ratio``).

A pair needs to be found only under its first shared shingle, so each index row carries how many
shingles of its set can still be shared there (the positional bound): less than the pair needs, and
the pair is left out. A list of classes under one key gives all pairs if it is short. A long list,
or one of a frequent key, gives the pairs with its pivot: the set with the smallest share of rare
shingles, the likely original of near copies. Pairs are verified exactly, and components found; then
only pairs of a long list (dealt by size classes and parts) that lie in different components, that
sizes and positions allow, and that the triangle inequality of the Jaccard distance to the pivot does not exclude, are verified as well.
No link between different sets is lost, and a group of near copies takes about a pair a member.
Frequent keys are aggregated before they are shuffled, and their join back can be split by skew.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than five words
are one shingle, none (or null text) give an empty set that links with nothing; rows that repeat
a document id stay, each with its component; a null id never is a component's id unless it is
alone (then null); ids may be of any type with an order; empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from speechlab.llm._common import free_name, hashed_words, join_counted, mix, small_side, stored, text_chunks

WORDS = 5
#: Bytes of text whose shingles are made together: temporary arrays are many times as large, and a worker keeps their memory.
CHUNK_BYTES = 1 << 18
#: Cells of the count sketch; lists up to this length are paired whole.
CELLS, SHORT = 1 << 19, 6
#: Sketches of tasks that are added up in one task, on average.
FAN_IN = 8
#: Rows of a component from which it is joined by broadcast.
LARGE_GROUP = 1000
#: Members of one size class of a long list that a join key holds, about.
LIST_PART = 1024
_C = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each document of a chunk."""
    found = hashed_words(data, bounds)
    h, cuts = found.hash, np.searchsorted(found.doc, np.arange(len(bounds)))
    rolled = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * _C + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= words:
            x = np.sort(rolled[a : b - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for v in h[a:b]:
                short = short * _C + v
            out.append(mix(short ^ np.uint64(0x5555)))
        else:
            out.append(rolled[:0])
    return out


def class_of(shingles: np.ndarray) -> int:
    """A hash of a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    total = np.array([mix(shingles ^ np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(mix(total).view(np.int64)[0]) or 1


def overlap_needed(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def class_ratio(percent: int) -> float:
    """Sizes of linked sets differ by at most this factor, so they lie in one size class or in neighbouring ones."""
    return max(1.3, 100 / percent * (1 + 1e-9))


def index_keys(shingles: np.ndarray, counts: np.ndarray, often: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of a set: of rare single shingles in their order, of combinations of frequent ones, and the number of rare ones."""
    n = len(shingles)
    seen = counts[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((shingles, seen))
    ranked = shingles[order]
    rare = int(np.searchsorted(seen[order], often))
    spare = n - overlap_needed(n, percent)
    single = ranked[: min(spare + 1, rare)]
    combined: list[np.ndarray] = []
    ratio = class_ratio(percent)
    tag = int(np.log(n) / np.log(ratio))
    for t in (tag, tag + 1):
        groups = int(0.05 * ratio**t)
        frequent = ranked[rare : min(n, spare + 1 + groups)]
        if not len(frequent):
            continue
        salt = mix(np.array([t + 1], dtype=np.uint64))
        if not groups:
            combined.append(mix(frequent ^ salt))
            continue
        group = frequent % np.uint64(groups)
        by = np.argsort(group, kind="stable")
        frequent, group = frequent[by], group[by]
        for gap in range(1, len(frequent)):
            same = group[gap:] == group[:-gap]
            if not same.any():
                break
            combined.append(mix(frequent[:-gap][same] * _C + frequent[gap:][same] + salt))
    return single, np.concatenate(combined) if combined else ranked[:0], rare


def _described(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``id, t, cls, n`` of each document, and in extra rows the count sketches of tasks as ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["id", "t", "cls", "n", "part"]
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for first, end, data, bounds in text_chunks(batch.column(2), CHUNK_BYTES):
                sets = shingle_sets(data, bounds)
                every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                total += np.bincount((every & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                own = batch.slice(first, end - first)
                cols = [own.column(0), own.column(1), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:4]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=names)

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType
    id_type = to_arrow_type(kind)
    return rows.mapInArrow(run, f"id {kind.simpleString()}, t long, cls long, n long, part binary")


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of the sketches in ``parts``, about ``FAN_IN`` of them in a task, and so on with their sums; one row comes to the driver.

    Not by an RDD: its Python workers are of another kind than a DataFrame's, and both kinds would stay in the executors.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(CELLS, dtype=np.int64), False
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(zlib.decompress(part.as_buffer()), dtype=np.int64)
                met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part"])

    n = parts.count()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(add, "part binary")
    total = np.zeros(CELLS, dtype=np.int64)
    for r in parts.collect():
        total += np.frombuffer(zlib.decompress(bytes(r["part"])), dtype=np.int64)
    return total


def _keys(docs: DataFrame, counts: np.ndarray, percent: int, text: str, often: int | None, frequent: bool) -> DataFrame:
    """``key, rank, cls, n, tail``: index rows of rare or of frequent keys, one for each class and key in a task.

    rank: the share of rare shingles in thousandths; tail: shingles of the set from the key's place on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts)
    often = int(4 * counts.mean() + 48) if often is None else often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0), CHUNK_BYTES):
                if len(known) > 1_000_000:
                    known = set()
                out: list[tuple[np.ndarray, ...]] = []
                for s in shingle_sets(data, bounds):
                    c = class_of(s)
                    if not len(s) or c in known:
                        continue
                    known.add(c)
                    single, combined, rare = index_keys(s, shared.value, often, percent)
                    key = combined if frequent else single
                    tail = np.full(len(key), len(s) - rare) if frequent else len(s) - np.arange(len(key))
                    if len(key):
                        out.append((key.view(np.int64), np.full(len(key), 1000 * rare // len(s)), np.full(len(key), c, dtype=np.int64), np.full(len(key), len(s)), tail))
                if out:
                    key, rank, cls, n, tail = (np.concatenate(x) for x in zip(*out))
                    cols = [pa.array(key), pa.array(rank.astype(np.int32)), pa.array(cls), pa.array(n.astype(np.int32)), pa.array(tail.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "rank", "cls", "n", "tail"])

    rows = docs.select(F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "key long, rank int, cls long, n int, tail int")


def _possible(na, nb, ta, tb, percent: int):
    """Whether sizes, and the shingles left from the key's place on, allow a link."""
    sizes = F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)
    return sizes & (F.lit(100 + percent) * F.least(ta, tb) >= F.lit(percent) * (na + nb))


_LISTED = "a long, b long, na int, nb int, ta int, tb int, base long"


def _rare_candidates(keys: DataFrame, percent: int, short_list: int) -> DataFrame:
    """``a, b, na, nb, ta, tb, base``: possible pairs of short lists (base null), and the pivot of a long list with each member (itself too)."""
    names = ["a", "b", "na", "nb", "ta", "tb", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        carried_long = False

        def emit(rows: list[np.ndarray], already: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray], bool]:
            """Pairs of all whole lists in ``rows``; the last list is carried on (a long one as its first row)."""
            key, cls, n, tail = rows
            new = np.concatenate([[True], key[1:] != key[:-1]])
            fresh = new | np.concatenate([[True], cls[1:] != cls[:-1]])
            key, cls, n, tail, new = (x[fresh] for x in (key, cls, n, tail, new))
            start = np.flatnonzero(new)
            size = np.diff(np.concatenate([start, [len(key)]]))
            long = size > short_list
            long[0] |= already
            of = np.repeat(np.arange(len(start)), size)
            last = len(start) - 1
            last_long = bool(long[last])
            keep = [x[start[last] :][: 1 if last_long else None] for x in (key, cls, n, tail)]
            out: list[tuple[np.ndarray, ...]] = []
            i = np.flatnonzero(long[of])
            if already:
                i = i[i != 0]  # the first row of a carried list was given before
            if len(i):
                f = start[of[i]]
                out.append((cls[f], cls[i], n[f], n[i], tail[f], tail[i], key[i], np.zeros(len(i), bool)))
            short = (~long[of]) & (of != last)
            for gap in range(1, short_list):
                i = np.flatnonzero(short[gap:] & (of[gap:] == of[:-gap]))
                if not len(i):
                    break
                j = i + gap
                fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                fits &= (100 + percent) * np.minimum(tail[i], tail[j]) >= percent * (n[i] + n[j])
                i, j = i[fits], j[fits]
                out.append((cls[i], cls[j], n[i], n[j], tail[i], tail[j], key[i], np.ones(len(i), bool)))
            if not out:
                return None, keep, last_long
            *cols, none = (np.concatenate(c) for c in zip(*out))
            arrays = [pa.array(c if k in (0, 1) else c.astype(np.int32)) for k, c in enumerate(cols[:6])]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[6], mask=none)], names=names), keep, last_long

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 2, 3, 4)]
            if carry is not None:
                rows = [np.concatenate([c, r]) for c, r in zip(carry, rows)]
            made, carry, carried_long = emit(rows, carried_long)
            if made is not None:
                yield made
        if carry is not None:
            end = [np.concatenate([c, c[-1:]]) for c in carry]  # another key after the last list closes it
            end[0][-1] = ~end[0][-1]
            made, _, _ = emit(end, carried_long)
            if made is not None:
                yield made

    # rare by an upper bound of their count, so no list is a hot one
    dealt = keys.repartition("key").sortWithinPartitions("key", "rank", "cls")
    return dealt.mapInArrow(run, _LISTED)


def _frequent_candidates(keys: DataFrame) -> DataFrame:
    """The same rows for frequent keys: the pivot of each with every member."""
    least = F.min(F.struct("rank", "cls", "n", "tail")).alias("f")
    heads = keys.groupBy("key").agg(least, F.max("cls").alias("high"), F.min("cls").alias("low"), F.count("*").alias("rows_of_key"))
    heads = stored(heads.where("low < high").select("key", "f", "rows_of_key"), "heads")
    rows = join_counted(keys, heads, ["key"], "rows_of_key")
    return rows.select(
        F.col("f.cls").alias("a"), F.col("cls").alias("b"), F.col("f.n").alias("na"), F.col("n").alias("nb"),
        F.col("f.tail").alias("ta"), F.col("tail").alias("tb"), F.col("key").alias("base"),
    )


def _verified(pairs: DataFrame, docs: DataFrame, described: DataFrame, percent: int, text: str, key: str) -> DataFrame:
    """``a, b, both, na, nb`` with the exact size of the intersection, for the sets of ``pairs``."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    one = described.where("n > 0").groupBy("cls").agg(F.min(F.struct("t", "id")).alias("r"))
    picked = stored(one.join(needed, "cls").select("r.t", "r.id"), "picked")
    marked = docs.select(F.col(key).alias("own"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    p = small_side(picked)
    rows = marked.join(p, (F.col("h") == p["t"]) & F.col("own").eqNullSafe(p["id"]), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0), CHUNK_BYTES):
                found = shingle_sets(data, bounds)
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["cls", "s"])

    own = rows.mapInArrow(sets, "cls long, s binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for x, y in zip(batch.column(4), batch.column(5)):
                u, v = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both.append(int((v[at] == u).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])

    joined = pairs.join(own.withColumnsRenamed({"cls": "a", "s": "sa"}), "a").join(own.withColumnsRenamed({"cls": "b", "s": "sb"}), "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(meet, "a long, b long, na int, nb int, both long")


def _linked(percent: int):
    return F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of each connected component) by alternating stars.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest
    neighbour, until nothing changes; rounds grow with the logarithm of a component's width.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        linked = large.join(small, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = stored(linked.union(small.select("x", F.col("m").alias("y"))).where("x <> y").distinct(), "edges")
    out = now.groupBy("x").agg(F.min("y").alias("component")).select(F.col("x").alias("node"), "component")
    return out.union(now.select("y", "y").distinct()).groupBy("node").agg(F.min("component").alias("component"))


def _grouped(docs: DataFrame, percent: int, text: str, key: str, often: int | None = None, short_list: int = SHORT, list_part: int = LIST_PART) -> DataFrame:
    """``id, t, n, g`` for every row of ``docs``: id, hash of the text, shingles, and the component's class (null without shingles)."""
    all_rows = stored(_described(docs, text, key), "described")
    described = all_rows.where("part is null").select("id", "t", "cls", "n")
    counts = _summed(all_rows.where("part is not null").select("part"))
    rare = _rare_candidates(_keys(docs, counts, percent, text, often, False), percent, short_list)
    frequent = _frequent_candidates(stored(_keys(docs, counts, percent, text, often, True), "frequent"))
    listed = stored(rare.union(frequent), "candidates")
    possible = _possible(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb"), percent)
    ordered = listed.where("a <> b").where(possible).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
        F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"),
    )
    pairs = stored(ordered.distinct(), "pairs")
    first = stored(_verified(pairs, docs, described, percent, text, key), "verified")
    links = first.where(_linked(percent)).select("a", "b")
    groups = stored(components(links), "components")

    # long lists: members of different components that may still be linked
    far = F.lit(1.0) - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    distance = first.select(F.col("a").alias("p"), F.col("b").alias("q"), far.alias("d"))
    distance = distance.union(distance.select("q", "p", "d"))
    long = listed.where("base is not null")
    members = long.select("base", F.col("a").alias("p"), F.col("b").alias("q"), F.col("nb").alias("n"), F.col("tb").alias("t"))
    # a set whose tail is too short for a partner of its own size or less is in no pair here
    members = members.where(F.lit(100) * F.col("t") >= F.lit(percent) * F.col("n"))
    labelled = members.join(groups, F.col("q") == F.col("node"), "left").select("base", "p", "q", "n", "t", F.coalesce("component", "q").alias("g"))
    labelled = stored(labelled, "members")
    split = labelled.groupBy("base").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("n_base")).where("low < high")
    rest = join_counted(labelled, stored(split.select("base", "n_base"), "split"), ["base"], "n_base").join(distance, ["p", "q"], "left")
    rest = rest.withColumn("d", F.when(F.col("p") == F.col("q"), F.lit(0.0)).otherwise(F.col("d")))
    # a list is dealt by the size of its sets (linked sets lie in one size class or neighbouring ones), and a large class over several keys
    rest = rest.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 1e-9)).cast("int"))
    rest = stored(rest.select("base", "size", "q", "n", "t", "g", "d").distinct(), "rest")
    deal = rest.groupBy("base", "size").agg(F.count("*").alias("n_class"), F.min("g").alias("low"), F.max("g").alias("high"))
    deal = stored(deal.select("base", "size", "n_class", F.ceil(F.col("n_class") / list_part).cast("int").alias("parts")), "deal")
    x = join_counted(rest, deal, ["base", "size"], "n_class").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    y = rest.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    y = join_counted(y, deal, ["base", "size"], "n_class").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = x.alias("x"), y.alias("y")
    near = F.col("x.d").isNull() | F.col("y.d").isNull()
    near = near | (F.abs(F.col("x.d") - F.col("y.d")) <= F.lit(1 - percent / 100 + 1e-9))
    together = (F.col("x.base") == F.col("y.base")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.part") == F.col("y.part"))
    apart = together & (F.col("x.g") != F.col("y.g")) & (F.col("x.q") < F.col("y.q"))
    across = x.join(y, apart & near & _possible(F.col("x.n"), F.col("y.n"), F.col("x.t"), F.col("y.t"), percent))
    more = across.select(F.col("x.q").alias("a"), F.col("y.q").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    more = stored(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"), "more")
    if more.limit(1).count():
        second = _verified(more, docs, described, percent, text, key).where(_linked(percent)).select("a", "b")
        groups = stored(components(links.union(second)), "components")

    known = described.join(groups, F.col("cls") == F.col("node"), "left")
    return known.select("id", "t", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("g"))


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id", often: int | None = None, short_list: int = SHORT) -> DataFrame:
    """``doc_id, n_shingles, component_id, t`` (t: hash of the text) for every row of ``docs``.

    often: the sketch count from which a shingle is frequent (None: from the mean count); short_list: the longest
    list that is paired whole. Neither changes the result.
    """
    known = _grouped(docs, percent, text, key, often, short_list)
    known = stored(known, "grouped")
    least = known.where("n > 0").groupBy("g").agg(F.min("id").alias("component_id"), F.count("*").alias("rows_of_g"))
    # a group of copies may hold a third of all rows: rows of large groups stay where they are
    linked = join_counted(known.where("n > 0"), stored(least, "least"), ["g"], "rows_of_g", LARGE_GROUP)
    alone = known.where("n = 0").withColumn("component_id", F.col("id"))
    columns = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "t"]
    return linked.select(*columns).union(alone.select(*columns))


def keep_one(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null only if there is no other), then text hash.

    Of rows that repeat this id and text, one stays. Every row without words stands alone and stays. Ids need not be
    there nor differ: rows go only if they are near duplicates.
    """
    marks = _grouped(docs, percent, text, key)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t")
    # partial minima, with the number of rows at the minimum, come before the shuffle
    places = marks.where("n > 0").groupBy("g", "id", "t").agg(F.count("*").alias("copies"))
    heads = places.groupBy("g").agg(F.min(F.struct(place.alias("place"), "copies")).alias("head")).select("head.place.id", "head.place.t", "head.copies")
    alone = marks.where("n = 0").select("id", "t").distinct().withColumn("copies", F.lit(1).cast("long"))
    kept = stored(heads.union(alone), "kept")
    own, head, head_hash = (free_name(docs.columns, n) for n in ("__t", "__id", "__head"))
    rows = docs.withColumn(own, F.xxhash64(text))

    def of(chosen: DataFrame) -> DataFrame:
        named = chosen.withColumnsRenamed({"id": head, "t": head_hash})
        return rows.join(named, F.col(key).eqNullSafe(F.col(head)) & (F.col(own) == F.col(head_hash)), "left_semi")

    once, more = kept.where("copies = 1").select("id", "t"), kept.where("copies > 1").select("id", "t")
    out = of(once)
    if more.limit(1).count():
        out = out.union(of(small_side(more)).dropDuplicates([key, own]))
    return out.drop(own)
