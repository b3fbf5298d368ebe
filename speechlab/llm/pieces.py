"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units that no piece crosses: line ends, runs without blanks with the blanks
before them. Distinct units become a lattice: substrings of bounded length are exploded,
equi-joined to the piece table and grouped by unit; a higher-order fold over the unit's edges
then picks its pieces. For a unigram model that fold is Viterbi (the path of the highest summed
score; ties go to the longer last piece). The installed model is a BPE model, for which the best
sum is not what the model defines: there the fold applies the model's merges over the same edges
(the adjacent pair whose joined edge scores highest, the leftmost of equals, until none is left).
A character that no edge covers falls back to its bytes.

The most frequent ``HEAD`` units of up to ``LONGEST`` characters, counted over all documents, take
this way, and the bounded table of their ids is broadcast; documents are then encoded by look-up.
Other units are folded alike where they occur, in the task, over the broadcast piece table (of
fixed size), since their own join would shuffle most of the corpus.

Defined results: null or empty text has no ids; decoding null gives null; repeated rows are encoded
alike; a ``\\u2581`` of the text is the same as a space, as in the model; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlab.llm._common import stored

HEAD, LONGEST = 1 << 17, 24
#: Tasks that the head's lattice and fold are dealt to, at most.
FOLD_TASKS = 256
#: Units that a worker remembers the ids of, in each of two generations: about 10 MB each, held for as long as the worker lives.
REMEMBERED = 50_000
BLANK = "▁"
UNIT = rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+"
#: What the fold subtracts from the lowest score for a character without an edge (unigram models).
UNKNOWN = 10.0


class Pieces(NamedTuple):
    """A model's pieces: id and score by text, the id of byte 0, all pieces by id, whether scores rank merges, and what is put before a text."""

    ids: dict[str, int]
    scores: dict[str, float]
    first_byte: int
    texts: list[str]
    merges: bool
    prefix: str = ""

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))


def load(path: str) -> Pieces:
    """Read a model file; it must fall back to bytes, and its pieces must respect the units."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that keep text as it is are supported")
    texts = [p.piece for p in model.pieces]
    usable = [i for i, p in enumerate(model.pieces) if p.type in (1, 4)]  # normal and user-defined pieces
    for i in usable:
        if len(texts[i]) > 1 and re.search(rf"[^{BLANK}]{BLANK}|\n", texts[i]):
            raise ValueError(f"piece {texts[i]!r} crosses units")
    first = texts.index("<0x00>")
    if texts[first : first + 256] != [f"<0x{b:02X}>" for b in range(256)]:
        raise ValueError("byte pieces are not in order")
    ids = {texts[i]: i for i in usable}
    return Pieces(ids, {texts[i]: float(model.pieces[i].score) for i in usable}, first, texts, model.trainer_spec.model_type == 2, " " if norm.add_dummy_prefix else "")


def units(text):
    """The units of a text column."""
    return F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit(BLANK)), F.lit(UNIT), F.lit(0))


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``word, edges``: for each word its substrings that are pieces, as (start from 1, length, id, score)."""
    at = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    cut = at.select("word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("i") + 1))).alias("l"))
    sub = cut.select("word", "i", "l", F.substring(F.col("word"), F.col("i"), F.col("l")).alias("piece"))
    edges = sub.join(F.broadcast(pieces), "piece")  # a vocabulary has a fixed size
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("i", "l", "id", "score")).alias("edges"))
    none = F.array().cast("array<struct<i:int,l:int,id:int,score:double>>")
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", none).alias("edges"))


def _edge(start, length):
    """The key of an edge: its start and length in one number."""
    return start.cast("long") * (1 << 32) + length


def _byte_ids(char, first_byte: int):
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda b: F.conv(F.substring(code, (b * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + first_byte)


def _ids_of(path, first_byte: int):
    """Ids of a path of (start, length): its edges' ids, or the bytes of a character without one."""

    def one(s):
        known = F.try_element_at(F.col("id_of"), _edge(s["i"], s["l"]))
        return F.when(known.isNotNull(), F.array(known)).otherwise(_byte_ids(F.substring(F.col("word"), s["i"], s["l"]), first_byte))

    return F.flatten(F.transform(path, one))


def merge_fold():
    """Merges over edges: from single characters, join the best adjacent pair until none has an edge."""

    def step(path, _):
        score = F.transform(
            F.when(F.size(path) > 1, F.sequence(F.lit(1), F.size(path) - 1)).otherwise(F.array().cast("array<int>")),
            lambda k: F.struct(
                F.try_element_at(F.col("score_of"), _edge(F.element_at(path, k)["i"], F.element_at(path, k)["l"] + F.element_at(path, k + 1)["l"])).alias("s"),
                (-k).alias("k"),
            ),
        )
        best = F.array_max(F.filter(score, lambda x: x["s"].isNotNull()))
        k = -best["k"]
        joined = F.array(F.struct(F.element_at(path, k)["i"].alias("i"), (F.element_at(path, k)["l"] + F.element_at(path, k + 1)["l"]).alias("l")))
        # a path that no pair can shorten stays as it is through the remaining steps
        return F.when(best.isNull(), path).otherwise(F.concat(F.slice(path, F.lit(1), k - 1), joined, F.slice(path, k + 2, F.size(path))))

    singles = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(i.alias("i"), F.lit(1).alias("l")))
    return F.aggregate(F.sequence(F.lit(1), F.length("word")), singles, step)


def viterbi_fold(lowest: float):
    """The path of the highest summed score: best sums by end position, then the way back."""
    floor = F.lit(lowest - UNKNOWN)

    def step(best, j):
        ending = F.filter(F.col("edges"), lambda e: e["i"] + e["l"] - 1 == j)
        ways = F.transform(ending, lambda e: F.struct((F.element_at(best, e["i"])["s"] + e["score"]).alias("s"), e["l"].alias("l")))
        single = F.exists(ending, lambda e: e["l"] == 1)
        fallback = F.array(F.struct((F.element_at(best, j)["s"] + floor).alias("s"), F.lit(1).alias("l")))
        return F.concat(best, F.array(F.array_max(F.when(single, ways).otherwise(F.concat(ways, fallback)))))

    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("l")))
    sums = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step)
    empty = F.array().cast("array<struct<i:int,l:int>>")

    def back(state, _):
        l = F.element_at(F.col("sums"), state["at"] + 1)["l"]
        here = F.array(F.struct((state["at"] - l + 1).alias("i"), l.alias("l")))
        return F.when(state["at"] > 0, F.struct((state["at"] - l).alias("at"), F.concat(here, state["path"]).alias("path"))).otherwise(state)

    walk = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.struct(F.length("word").alias("at"), empty.alias("path")), back, lambda s: s["path"])
    return sums, walk


def encode_words(words: DataFrame, model: Pieces, merges: bool | None = None) -> DataFrame:
    """``word, ids`` of distinct words without spaces, by the lattice; merges None: as the model's kind asks."""
    spark = words.sparkSession
    columns = [pa.array(model.ids, pa.string()), pa.array(model.ids.values(), pa.int32()), pa.array([model.scores[p] for p in model.ids], pa.float64())]
    # from Arrow: a list of rows would pass through Python workers of another kind, which then stay beside the others
    table = spark.createDataFrame(pa.table(columns, names=["piece", "id", "score"]), "piece string, id int, score double")
    edges = lattice(words.where(F.length("word") > 0), table, model.longest)
    keyed = edges.select(
        "word", "edges",
        F.map_from_entries(F.transform("edges", lambda e: F.struct(_edge(e["i"], e["l"]), e["id"]))).alias("id_of"),
        F.map_from_entries(F.transform("edges", lambda e: F.struct(_edge(e["i"], e["l"]), e["score"]))).alias("score_of"),
    )
    if model.merges if merges is None else merges:
        path = keyed.withColumn("path", merge_fold())
    else:
        sums, walk = viterbi_fold(min(model.scores.values()))
        path = keyed.withColumn("sums", sums).withColumn("path", walk)
    return path.select("word", _ids_of(F.col("path"), model.first_byte).alias("ids"))


def fold_unit(word: str, model: Pieces) -> list[int]:
    """The same fold for one unit of any length: short ones by a scan, long ones in n log n (merges), or n times the longest piece (Viterbi)."""
    ids, scores = model.ids, model.scores
    n = len(word)
    if model.merges and n <= 48:
        get, none = scores.get, float("-inf")
        parts = list(word)
        rank = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank and (best := max(rank)) != none:
            i = rank.index(best)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
        return [x for p in parts for x in ((ids[p],) if p in ids else (model.first_byte + b for b in p.encode()))]
    if model.merges:
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[p], i, 2) for i in range(n - 1) if (p := word[i : i + 2]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, total = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != total:
                continue
            size[i], size[j], after[i] = total, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := word[a : b + size[b]]) in scores:
                    heapq.heappush(heap, (-scores[p], a, len(p)))
        cuts = [(i, size[i]) for i in range(n) if size[i]]
    else:
        floor, longest = min(scores.values()) - UNKNOWN, model.longest
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, n + 1):
            ways = [(best[j - l][0] + scores[p], l) for l in range(1, min(longest, j) + 1) if (p := word[j - l : j]) in scores]
            if word[j - 1] not in scores:
                ways.append((best[j - 1][0] + floor, 1))
            best.append(max(ways))
        cuts, j = [], n
        while j:
            cuts.insert(0, (j - best[j][1], best[j][1]))
            j -= best[j][1]
    out: list[int] = []
    for i, l in cuts:
        piece = word[i : i + l]
        out += [ids[piece]] if piece in ids else [model.first_byte + b for b in piece.encode()]
    return out


@lru_cache(maxsize=1)
def _remembered(path: str) -> dict[str, dict[str, bytes]]:
    """A worker's memory of units beyond the head, kept from task to task."""
    return {"young": {}, "old": {}}


def head_table(docs: DataFrame, model: Pieces, text: str = "text", head: int = HEAD) -> DataFrame:
    """``word, ids`` of the most frequent units of all documents, at most ``head``.

    Units are taken by count, in steps of a 64th of a doubling: as many whole steps as ``head`` holds.
    So nothing is sorted and no task takes more than its share.
    """
    whole = F.when(F.col(text) != "", F.concat(F.lit(model.prefix), F.col(text)))
    every = docs.select(F.explode(units(whole)).alias("word"))
    counts = every.groupBy("word").agg(F.floor(F.log2(F.count("*").cast("double")) * 64).cast("int").alias("step"))
    counts = stored(counts.where(F.length("word") <= LONGEST), "units")
    least, taken = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # 64 rows for each doubling
        if taken + r["count"] > head:
            break
        least, taken = r["step"], taken + r["count"]
    words = counts.where(F.col("step") >= least) if least is not None else counts.limit(0)
    # a stated number of partitions is not coalesced: the fold is the work, not the bytes
    return encode_words(words.select("word").repartition(max(1, min(FOLD_TASKS, taken // 256)), "word"), model)


def _shared(docs: DataFrame, path: str, text: str, head: int):
    """The vocabulary and the head's ids, broadcast: at most ``head`` units of LONGEST characters."""
    model = load(path)
    # at most ``head`` rows, all tasks at once (an iterator over partitions would fold them one after the other)
    rows = head_table(docs, model, text, head).toArrow().combine_chunks()
    table: dict[str, bytes] = {}
    if rows.num_rows:
        ids = rows.column("ids").combine_chunks()
        flat, bounds = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_pylist()
        table = {w: flat[a:b].tobytes() for w, a, b in zip(rows.column("word").to_pylist(), bounds, bounds[1:])}
    return docs.sparkSession.sparkContext.broadcast((model, table))


def _encoder(m: Pieces, known: dict[str, bytes], path: str):
    """A function from a text, or null, to its packed ids."""
    find, memory = re.compile(UNIT).findall, _remembered(path)

    def one(own: str | None) -> bytes:
        young, old = memory["young"], memory["old"]
        row = []
        for u in find((m.prefix + own).replace(" ", BLANK)) if own else ():
            got = known.get(u) or young.get(u)
            if got is None:
                got = old.get(u)
                if got is None:
                    got = np.array(fold_unit(u, m), dtype="<u4").tobytes()
                if len(u) <= 64:
                    young[u] = got
            row.append(got)
            if len(young) > REMEMBERED:
                memory["old"], memory["young"] = young, {}
                young, old = memory["young"], memory["old"]
        return b"".join(row)

    return one


def _decoder(m: Pieces):
    """A function from packed ids, or null, to their text."""
    raw = [t.replace(BLANK, " ").encode() for t in m.texts]
    raw[m.first_byte : m.first_byte + 256] = [bytes([b]) for b in range(256)]

    def one(ids: bytes | None) -> str | None:
        if ids is None:
            return None
        return b"".join([raw[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode(errors="replace").removeprefix(m.prefix)

    return one


def _by_row(df: DataFrame, make, schema: str, keep: list[str], column: str) -> DataFrame:
    """``keep`` beside what ``make()`` gives for the values of a column, 512 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                new = work(v.as_py() for v in part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, *new.values()], names=[*keep, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col(column).alias("__value")).mapInArrow(run, f"{fields}, {schema}")


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", head: int = HEAD) -> DataFrame:
    """``keep`` and ``ids`` (32-bit little-endian ids in one binary) of every whole text; path: a model file all executors have."""
    shared = _shared(docs, path, text, head)

    def make():
        one = _encoder(*shared.value, path)
        return lambda texts: {"ids": pa.array([one(t) for t in texts], pa.binary())}

    return _by_row(docs, make, "ids binary", keep, text)


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and the ``decoded`` text of packed ids; bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def make():
        one = _decoder(shared.value)
        return lambda values: {"decoded": pa.array([one(v) for v in values], pa.string())}

    return _by_row(encoded, make, "decoded string", keep, ids)


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, round_trip``: sizes and checksums of the ids, and whether they decode to the text.

    Both ways are one pass over the texts, so a task holds one Python worker.
    """
    shared = _shared(docs, path, "text", HEAD)

    def make():
        m, known = shared.value
        there, back = _encoder(m, known, path), _decoder(m)

        def work(texts):
            ids, same = [], []
            for t in texts:
                ids.append(there(t))
                same.append(back(ids[-1]) == (t or ""))
            return {"ids": pa.array(ids, pa.binary()), "round_trip": pa.array(same)}

        return work

    out = _by_row(docs, make, "ids binary, round_trip boolean", ["doc_id"], "text")
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")
