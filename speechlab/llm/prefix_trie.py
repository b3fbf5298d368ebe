"""The trie of conversations that share first turns, by blocks of turns first and by single turns where siblings diverge.

A prefix is known by its depth and two 64-bit keys: exclusive ors of hashes of (place, role, text) over its turns, so that
the prefix after a block is the prefix before it combined with the block's digest. The way:

1. turns are numbered in their conversations over all partitions (``ordered.positions``) as digests and sizes, without texts;
2. turns are gathered into blocks, and conversations are grouped by (prefix before the block, block): one entry for
   each distinct block, with the number of conversations and the smallest of them;
3. an entry without siblings is a path: its turns are nodes as they stand. Only where a prefix goes on with different blocks are
   turns taken one by one and grouped by their own prefixes;
4. sums over subtrees: each node is owned by the entry of its smallest conversation, and what an entry owns is added to
   the block boundaries above it, then, within blocks, to the turns above.

A block holds ``block`` turns, or the square root of the longest conversation's number if that is more: then neither a
block nor the boundaries above it outgrow a row, and all steps together are linear in turns.

Defined results: rows with a null conversation take no part; null role or text is empty; a null turn comes first and
equal turns are ordered by their digest; repeated rows are turns of their own; an empty table has no node, not even
the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlab.llm._common import join_counted, stored
from speechlab.operators.ordered import positions

#: Bytes of joined ids that one row of ``_hashed_members`` holds at most.
CHUNK = 1 << 20
_NODE = ["depth", "p1", "p2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, i1, i2, bytes``: each turn's place, 128 bits of its SHA-256, and its text's size."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    half = [F.conv(F.substring("digest", a, 16), 16, -10).cast("long").alias(name) for a, name in ((1, "i1"), (17, "i2"))]
    slim = rows.select("conv_id", "turn", *half, "bytes")
    return positions(slim, [F.col("turn").asc_nulls_first(), "i1", "i2"], ["conv_id"]).drop("turn")


def grafted(turns: DataFrame, head: Column, onto: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of another: ``(c, n_turns)`` and ``(c, pos, i1, i2, bytes)``.

    ``head`` (at most ``longest_head``) and ``onto`` are columns of ``conv_id``: c becomes the first ``head`` turns of
    ``onto``, then its own turns after its first ``head``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = sizes.select("conv_id", "n", head.alias("h"), onto.alias("onto"))
    lengths = sizes.select(F.col("conv_id").alias("onto"), F.col("n").alias("n_onto"))
    # a conversation is joined to the few that take its head
    plan = plan.join(lengths, "onto", "left").withColumn("m", F.least("h", F.coalesce("n_onto", F.lit(0))))
    plan = stored(plan.select("conv_id", "n", "h", "onto", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "plan")
    own = join_counted(turns, plan, ["conv_id"]).where("position > h").select(F.col("conv_id").alias("c"), (F.col("m") + F.col("position") - F.col("h")).alias("pos"), "i1", "i2", "bytes")
    heads = turns.where(F.col("position") <= longest_head).withColumnRenamed("conv_id", "onto")
    taken = heads.join(plan.select(F.col("conv_id").alias("c"), "onto", "m"), "onto").where("position <= m").select("c", F.col("position").alias("pos"), "i1", "i2", "bytes")
    return plan.select(F.col("conv_id").alias("c"), "n_turns"), own.unionByName(taken)


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """``c, j, turns, len, s1, s2, e1, e2, path, final``: blocks with the prefixes before and after them.

    ``turns`` holds (p1, p2, bytes) of each turn, ``path`` the boundaries (depth, p1, p2) from the root to the block's start.
    """
    keyed = turns.select("c", ((F.col("pos") - 1) / size).cast("long").alias("j"), "pos", F.xxhash64("pos", "i1", "i2").alias("x1"), F.xxhash64(F.lit("second"), "i2", "i1", "pos").alias("x2"), "bytes")
    within = Window.partitionBy("c", "j").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumns({q: F.bit_xor(x).over(within) for q, x in (("q1", "x1"), ("q2", "x2"))})
    gathered = keyed.groupBy("c", "j").agg(F.sort_array(F.collect_list(F.struct("pos", "q1", "q2", "bytes"))).alias("own"))
    gathered = stored(gathered.withColumn("len", F.size("own").cast("long")), "blocks")
    along = Window.partitionBy("c").orderBy("j")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    slim = gathered.select("c", "j", F.element_at("own", -1).alias("z"))
    slim = slim.select("c", "j", *[F.coalesce(F.bit_xor(f"z.q{k}").over(before), F.lit(0)).alias(f"s{k}") for k in (1, 2)], *[F.bit_xor(f"z.q{k}").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(f"e{k}") for k in (1, 2)], F.lead("j").over(along).isNull().alias("final"))
    boundary = F.struct((F.col("j") * size).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    slim = slim.withColumn("path", F.collect_list(boundary).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    absolute = F.transform("own", lambda x: F.struct(x.q1.bitwiseXOR(F.col("s1")).alias("p1"), x.q2.bitwiseXOR(F.col("s2")).alias("p2"), x.bytes.alias("bytes")))
    return gathered.join(slim, ["c", "j"]).select("c", "j", absolute.alias("turns"), "len", "s1", "s2", "e1", "e2", "path", "final")


def _hashed_members(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` of the ascending ids ``c`` at each node, joined by commas.

    Ids are dealt by range and joined where they lie, so a node of very many comes to its hashing task in rows of
    up to ``CHUNK`` bytes, which pass through one after another (SHA-256 can't be divided).
    """
    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            cols = [*(pa.array([v], pa.int64()) for v in node), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])]
            return pa.RecordBatch.from_arrays(cols, names=[*_NODE, "c", "ids"])

        for batch in batches:
            for *key, c in zip(*(col.to_pylist() for col in batch.columns)):
                if node is not None and (key != node or size > CHUNK - 32):
                    yield out()
                    held, size = [], 0
                node = key
                held.append(c)
                size += len(str(c)) + 1
        if node is not None:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield _rows(done)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    dealt = ends.select(*_NODE, "c").repartitionByRange(n, *_NODE, "c").sortWithinPartitions(*_NODE, "c")
    chunks = dealt.mapInArrow(join, "depth long, p1 long, p2 long, c long, ids string")
    return chunks.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "c").mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    depth, p1, p2, digest = zip(*done)
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (depth, p1, p2)), pa.array(digest)], names=[*_NODE, "ends_sha256"])


def trie(sizes: DataFrame, turns: DataFrame, block: int = 4) -> DataFrame:
    """The nodes of the trie over conversations ``sizes`` (c, n_turns) and their ``turns`` (c, pos, i1, i2, bytes).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    whole = sizes.agg(F.count("*").alias("n"), F.min("c").alias("c"), F.max("n_turns").alias("longest")).first()
    size = max(block, math.isqrt(whole["longest"] or 0) + 1)
    blocks = stored(_blocks(turns, size), "placed")
    entry = ["j", "s1", "s2", "e1", "e2", "len"]
    groups = blocks.groupBy(*entry).agg(F.count("*").alias("n"), F.min("c").alias("c"))
    entries = stored(groups.join(blocks.select("c", "j", "turns", "path"), ["c", "j"]), "entries")
    siblings = entries.groupBy("j", "s1", "s2").agg(F.count("*").alias("siblings"))
    entries = stored(join_counted(entries, siblings, ["j", "s1", "s2"], n="siblings").withColumn("alone", F.col("siblings") == 1), "siblings")

    def by_turn(rows: DataFrame, *more: str) -> DataFrame:
        at = rows.select("j", "s1", "s2", "n", "c", "alone", "turns", *more, F.posexplode("turns").alias("t", "x"))
        parent = F.when(F.col("t") > 0, F.get("turns", F.col("t") - 1))
        above = [F.coalesce(parent[f"p{k}"], F.col(f"s{k}")).alias(f"a{k}") for k in (1, 2)]
        depth = (F.col("j") * size + F.col("t") + 1).alias("depth")
        return at.select(depth, "x.p1", "x.p2", "x.bytes", *above, "n", "c", "alone", *more)

    each = by_turn(entries)
    columns = [*_NODE, "a1", "a2", "bytes", "n", "c"]
    diverging = each.where("not alone").groupBy(*_NODE, "a1", "a2", "bytes").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    nodes = stored(each.where("alone").select(*columns).unionByName(diverging.select(*columns)), "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(F.count("*").alias("n_children"))
    children = stored(children, "children")
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes, "parents")

    # what the entry of a node's smallest conversation owns: at most a block of turns
    own = F.struct("depth", ((F.col("n") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = nodes.groupBy(((F.col("depth") - 1) / size).cast("long").alias("j"), "c").agg(F.collect_list(own).alias("owned"))
    owners = entries.join(owned, ["j", "c"], "left").withColumn("owned", F.coalesce("owned", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))), lambda x: F.lit(False))))

    def total(field: str, least: Column | None = None) -> Column:
        rows = F.col("owned") if least is None else F.filter("owned", lambda x: x.depth >= least)
        return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x[field])

    owners = stored(owners, "owners")
    below = owners.select(F.explode("path").alias("b"), total("saved").alias("saved"), total("leaf").alias("leaves")).groupBy("b.depth", "b.p1", "b.p2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    below = stored(below, "below")
    ending = below.select(((F.col("depth") / size).cast("long") - 1).alias("j"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), F.col("saved").alias("saved_end"), F.col("leaves").alias("leaves_end"), F.lit(size).cast("long").alias("len"))
    reached = owners.join(ending, ["j", "e1", "e2", "len"], "left").fillna(0, ["saved_end", "leaves_end"])
    parts = by_turn(reached, "owned", "saved_end", "leaves_end").select(
        *_NODE, "alone", (total("saved", F.col("depth")) + F.col("saved_end")).alias("saved"), (total("leaf", F.col("depth")) + F.col("leaves_end")).alias("leaves")
    )
    sums = parts.where("alone").drop("alone").unionByName(parts.where("not alone").groupBy(*_NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))

    if not whole["n"]:
        members = sizes.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "c").limit(0)
    else:
        zero = [F.lit(0).cast("long").alias(k) for k in _NODE]
        members = blocks.where("final").select((F.col("j") * size + F.col("len")).alias("depth"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), "c").unionByName(sizes.where("n_turns = 0").select(*zero, "c"))
    hashed = _hashed_members(members)

    up = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("c").alias("parent_conv_id"), "n_children")
    lower = nodes.where("depth > 1").withColumn("up", F.col("depth") - 1).drop("n_children")
    lower = join_counted(lower, up, ["up", "a1", "a2"], n="n_children").select(*_NODE, "parent_conv_id")
    first = nodes.where("depth = 1").select(*_NODE, F.lit(whole["c"]).cast("long").alias("parent_conv_id"))
    out = nodes.select(*_NODE, "c", "n", "n_children").join(sums, _NODE).join(lower.unionByName(first), _NODE)
    root = sizes.sparkSession.range(1 if whole["n"] else 0).select(*[F.lit(0).cast("long").alias(k) for k in _NODE], F.lit(whole["c"]).cast("long").alias("c"), F.lit(whole["n"]).cast("long").alias("n"))
    root = root.join(children, _NODE, "left").join(below, _NODE, "left").select(*_NODE, "c", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.lit(None).cast("long").alias("parent_conv_id"))
    all_nodes = out.unionByName(root).join(hashed, _NODE, "left")
    return all_nodes.select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
