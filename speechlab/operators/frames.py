"""Frame tables: one row for a frame of a recording, with a probability for each phone (the last: silence)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from speechlab.functions.phonetics import collapse_runs
from speechlab.operators.sequences import align, edit_distance
from speechlab.operators.windows import order_positions
from speechlab.plans.scratch import kept


def argmax_phone(probs: Column) -> Column:
    """Index, from 0, of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("long")


def drop_silence(frames: DataFrame) -> DataFrame:
    """Frames whose silence probability is not the maximum, with a dense number ``t`` from 0."""
    kept = frames.where(F.element_at("probs", -1) < F.array_max("probs"))
    return kept.withColumn("t", (F.row_number().over(Window.partitionBy("rec_id").orderBy("frame_idx")) - 1).cast("long"))


#: Cells (frames times phones) of a recording up to which a task takes it whole, and frames of a block beyond.
WHOLE_CELLS, FRAME_BLOCK = 1 << 24, 256


def force_align(frames: DataFrame, targets: DataFrame, whole_cells: int = WHOLE_CELLS, block: int = FRAME_BLOCK) -> DataFrame:
    """``rec_id, cost, path``: the cheapest monotone assignment of a recording's frames to its expected phones.

    The cost of a frame is minus the probability of its phone; each frame keeps the phone or goes on to the
    next; the path runs from the first phone to the last (ties go on). Fewer frames than phones, or no frame, give nulls.
    Recordings of up to ``whole_cells`` cells are grouped side by side with their phones, a byte a cell. Longer ones pass through
    their task in blocks of frames twice (``_in_blocks``): a task holds a block's cells and never the recording.
    """
    own = frames.select("rec_id", "t", F.col("probs").cast("array<double>").alias("probs"))
    goals = targets.select("rec_id", "pos", F.col("phone_id").cast("long").alias("phone_id"))
    # only recordings with a frame for each phone go to tasks of Python
    sizes = goals.groupBy("rec_id").agg(F.count("*").alias("n")).join(own.groupBy("rec_id").agg(F.count("*").alias("t")), "rec_id", "left")
    sizes = kept(sizes.select("rec_id", (F.col("n") * F.col("t")).alias("cells"), F.coalesce(F.col("t") >= F.col("n"), F.lit(False)).alias("able")))
    nothing = sizes.where("not able").select("rec_id", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("array<int>").alias("path"))
    able = sizes.where("able").select("rec_id")
    own, goals = own.join(able, "rec_id", "left_semi"), goals.join(able, "rec_id", "left_semi")
    long = sizes.where(F.col("able") & (F.col("cells") > whole_cells)).select("rec_id")
    if not long.limit(1).count():
        return _whole(own, goals).unionByName(nothing)
    parts = [(x.join(long, "rec_id", "left_anti"), x.join(long, "rec_id", "left_semi")) for x in (own, goals)]
    return _whole(parts[0][0], parts[1][0]).unionByName(_in_blocks(parts[0][1], parts[1][1], block)).unionByName(nothing)


def _next_row(row: np.ndarray | None, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs up to the next frame, whose phones have the probabilities ``p``, and where the path comes from the phone before."""
    if row is None:
        row = np.full(len(p), np.inf)
        row[0] = -p[0]
        return row, np.zeros(len(p), dtype=bool)
    before = np.concatenate([[np.inf], row[:-1]])
    on = (before <= row) & np.isfinite(before)
    return np.where(on, before, row) - p, on


def _whole(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """``force_align`` of recordings that fit a task."""

    def align_one(key: tuple, frame_rows: pa.Table, goal_rows: pa.Table) -> pa.Table:
        goal = goal_rows.sort_by("pos").column("phone_id").to_numpy().astype(np.int64)
        if not len(goal):
            return empty
        t, n = frame_rows.num_rows, len(goal)
        cost, path = None, None
        if t >= n:
            flat = frame_rows.sort_by("t").column("probs").combine_chunks()
            p = flat.flatten().to_numpy().reshape(t, -1)[:, goal]
            row, on = None, np.zeros((t, n), dtype=bool)
            for i in range(t):
                row, on[i] = _next_row(row, p[i])
            cost, j, path = float(row[-1]), n - 1, []
            for i in range(t - 1, -1, -1):
                path.append(j)
                j -= int(on[i, j])
            path.reverse()
        columns = [pa.array([key[0].as_py()], kind), pa.array([cost], pa.float64()), pa.array([path], pa.list_(pa.int32()))]
        return pa.Table.from_arrays(columns, names=["rec_id", "cost", "path"])

    kind = to_arrow_type(targets.schema["rec_id"].dataType)
    schema = f"rec_id {targets.schema['rec_id'].dataType.simpleString()}, cost double, path array<int>"
    empty = pa.table({"rec_id": pa.array([], kind), "cost": pa.array([], pa.float64()), "path": pa.array([], pa.list_(pa.int32()))})
    return frames.groupBy("rec_id").cogroup(targets.groupBy("rec_id")).applyInArrow(align_one, schema)


def _in_blocks(frames: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``force_align`` of long recordings: blocks of frames stream through a task forward, then backward.

    Forward, the costs before each block are put out (a row for each block); backward, a block's cells are computed again
    from them, and the path goes through the block from where it left the one behind.
    """
    kind = targets.schema["rec_id"].dataType.simpleString()
    n_parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.array_sort(F.collect_list(F.struct("t", "probs")))
    cut = frames.groupBy("rec_id", F.floor(F.col("t") / block).cast("long").alias("block")).agg(F.transform(order, lambda x: x["probs"]).alias("probs"))
    cut = kept(cut.withColumn("n", F.size("probs").cast("long")))
    goal = F.transform(F.array_sort(F.collect_list(F.struct("pos", "phone_id"))), lambda x: x["phone_id"])
    goals = kept(targets.groupBy("rec_id").agg(goal.alias("goal")))
    nothing = {"probs": "array<array<double>>", "goal": "array<bigint>", "costs": "array<double>"}
    none = lambda name: F.lit(None).cast(nothing[name]).alias(name)

    def streamed(rows: DataFrame, first: int, up: bool, work: Callable, schema: str) -> DataFrame:
        """``work`` over each recording's goal and then its blocks in order, a row at a time."""
        head = goals.select("rec_id", F.lit(first).cast("long").alias("block"), none("probs"), "goal", none("costs"))
        both = head.unionByName(rows.select("rec_id", "block", "probs", none("goal"), "costs")).repartition(n_parts, "rec_id")
        return both.sortWithinPartitions("rec_id", F.col("block").asc() if up else F.col("block").desc()).mapInArrow(work, schema)

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rec, at, probs, goal, costs = (batch.column(c)[k : k + 1] for c in range(5))
                p = None if probs.null_count else probs.flatten()
                p = None if p is None else p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
                yield rec, at[0].as_py(), p, (None if goal.null_count else goal.flatten().to_numpy()), (None if costs.null_count else costs.flatten().to_numpy())

    def forward(batches):
        goal, row = None, None
        for rec, at, p, own, _ in each(batches):
            if own is not None:
                goal, row = own, None
                continue
            before = None if row is None else row.tolist()
            for frame in p:
                row, _ = _next_row(row, frame[goal])
            # the costs after the block come as the last row's cost
            yield pa.RecordBatch.from_arrays([rec, pa.array([at], pa.int64()), pa.array([before], pa.list_(pa.float64())), pa.array([float(row[-1])])], names=["rec_id", "block", "costs", "cost"])

    def backward(batches):
        goal, j = None, None
        for rec, at, p, own, costs in each(batches):
            if own is not None:
                goal, j = own, len(own) - 1
                continue
            row, on = costs, np.zeros((len(p), len(goal)), dtype=bool)
            for i, frame in enumerate(p):
                row, on[i] = _next_row(row, frame[goal])
            path = []
            for i in range(len(p) - 1, -1, -1):
                path.append(j)
                j -= int(on[i, j])
            yield pa.RecordBatch.from_arrays([rec, pa.array([at], pa.int64()), pa.array([path[::-1]], pa.list_(pa.int32()))], names=["rec_id", "block", "path"])

    marks = kept(streamed(cut.withColumn("costs", none("costs")), -1, True, forward, f"rec_id {kind}, block long, costs array<double>, cost double"))
    parts = streamed(cut.join(marks.select("rec_id", "block", "costs"), ["rec_id", "block"]), (1 << 62), False, backward, f"rec_id {kind}, block long, path array<int>")
    paths = parts.groupBy("rec_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "path"))), lambda x: x["path"])).alias("path"))
    ends = marks.groupBy("rec_id").agg(F.max_by("cost", "block").alias("cost")).join(cut.groupBy("rec_id").agg(F.sum("n").alias("t")), "rec_id")
    whole = ends.join(goals.select("rec_id", F.size("goal").alias("n")), "rec_id").join(paths, "rec_id")
    able = F.col("t") >= F.col("n")
    return whole.select("rec_id", F.when(able, F.col("cost")).alias("cost"), F.when(able, F.col("path")).alias("path"))


def _runs(rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("rec_id").orderBy(order)
    before = F.lag("phone").over(w)
    return rows.withColumn("__new", (before.isNull() | (before != F.col("phone"))).cast("long")).withColumn("run", F.sum("__new").over(w)).drop("__new")


def posterior_runs(frames: DataFrame, least: float, silence: int) -> DataFrame:
    """Runs of equal best phones without silence whose highest probability exceeds ``least``; runs that then are neighbours are one.

    ``rec_id, run, phone, n_frames, p_max, p_mean`` (over frames), ``first_frame``; runs are numbered from 1.
    """
    best = frames.select("rec_id", "frame_idx", argmax_phone(F.col("probs")).alias("phone"), F.array_max("probs").alias("p")).where(F.col("phone") != silence)
    each = _runs(best, "frame_idx").groupBy("rec_id", "run", "phone").agg(F.count("*").alias("n"), F.max("p").alias("m"), F.sum("p").alias("s"), F.min("frame_idx").cast("long").alias("first"))
    again = _runs(each.where(F.col("m") > least).drop("run"), "first")
    return again.groupBy("rec_id", "run", "phone").agg(F.sum("n").alias("n_frames"), F.max("m").alias("p_max"), (F.sum("s") / F.sum("n")).alias("p_mean"), F.min("first").alias("first_frame"))


def pool(frames: DataFrame, part: list[str], how: str = "mean") -> DataFrame:
    """``part, phone, p``: mean (or max) probability of each phone over the frames of a group."""
    agg = {"mean": F.avg, "max": F.max}[how]
    return frames.select(*part, F.posexplode("probs").alias("phone", "p")).groupBy(*part, "phone").agg(agg("p").alias("p"))


def halve_shared_runs(path: DataFrame) -> DataFrame:
    """``path`` (``rec_id, frame_idx, pos, phone_id``) with runs of frames that adjacent equal targets share cut into equal parts.

    The frames of k neighbouring positions of one phone are dealt to them in order, floor(n / k) each, the rest to the last.
    """
    w = Window.partitionBy("rec_id").orderBy("pos")
    positions = path.select("rec_id", "pos", "phone_id").distinct()
    new = F.coalesce((F.lag("phone_id").over(w) != F.col("phone_id")).cast("long"), F.lit(1))
    groups = positions.withColumn("__new", new).withColumn("__g", F.sum("__new").over(w)).drop("__new")
    groups = groups.withColumn("__k", F.count("*").over(Window.partitionBy("rec_id", "__g"))).withColumn("__low", F.min("pos").over(Window.partitionBy("rec_id", "__g")))
    rows = path.join(groups.select("rec_id", "pos", "__g", "__k", "__low"), ["rec_id", "pos"])
    of = Window.partitionBy("rec_id", "__g")
    at, n = F.row_number().over(of.orderBy("frame_idx")) - 1, F.count("*").over(of)
    share = F.greatest(F.floor(n / F.col("__k")), F.lit(1))
    return rows.withColumn("__p", F.col("__low") + F.least(F.floor(at / share), F.col("__k") - 1)).select("rec_id", "frame_idx", F.col("__p").cast("long").alias("pos"), "phone_id")


def path_rows(aligned: DataFrame, targets: DataFrame) -> DataFrame:
    """``rec_id, t, pos, phone_id``: the paths of ``force_align`` as rows, one for each frame; recordings without a path go."""
    rows = aligned.where("path is not null").select("rec_id", F.posexplode("path").alias("t", "pos"))
    return rows.select("rec_id", F.col("t").cast("long").alias("t"), F.col("pos").cast("long").alias("pos")).join(targets.select("rec_id", F.col("pos").cast("long").alias("pos"), "phone_id"), ["rec_id", "pos"])


def pooled_segments(path: DataFrame, frames: DataFrame, how: str = "mean", step: float = 0.02) -> DataFrame:
    """``rec_id, pos, phone_id, predicted, p_true, p_predicted, n_frames, start, end`` of each aligned phone.

    path: ``rec_id, frame_idx, pos, phone_id``; probabilities are pooled over a position's frames, whose best phone is the predicted one.
    """
    rows = halve_shared_runs(path).join(frames.select("rec_id", "frame_idx", "probs"), ["rec_id", "frame_idx"])
    pooled = pool(rows, ["rec_id", "pos"], how).groupBy("rec_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("phone", "p"))), lambda x: x["p"]).alias("probs"))
    bounds = rows.groupBy("rec_id", "pos", "phone_id").agg(F.count("*").alias("n_frames"), (F.min("frame_idx") * step).alias("start"), ((F.max("frame_idx") + 1) * step).alias("end"))
    both = bounds.join(pooled, ["rec_id", "pos"])
    return both.select("rec_id", "pos", "phone_id", argmax_phone(F.col("probs")).alias("predicted"), F.get("probs", F.col("phone_id").cast("int")).alias("p_true"), F.array_max("probs").alias("p_predicted"), "n_frames", "start", "end")


def word_segments(segments: DataFrame, indexed: DataFrame, word: int) -> DataFrame:
    """Segments (``rec_id, pos``) of one word, by the word of each phone place (``rec_id, pos, word_idx``)."""
    return segments.join(indexed.where(F.col("word_idx") == word).select("rec_id", "pos", "word_idx"), ["rec_id", "pos"])


def detected_flag(status: Column) -> Column:
    """The flag that a recording's status is reported by."""
    return (
        F.when(status == "success", "speech").when(status == "empty", "empty_audio").when(status == "too short", "too_short")
        .when(status == "too long", "too_long").when(status.isin("too quiet", "no sound"), "too_quiet").otherwise("nonsense")
    )


def recording_check(frames: DataFrame, expected: DataFrame, least: float, silence: int) -> DataFrame:
    """``rec_id, error_rate, standard_rate, silent_share, count_ratio`` of each recording with expected phones (``rec_id, pos, phone_id``).

    Phones found are the runs of best phones over ``least``. error_rate: edit distance of the two aligned arrays, gaps
    included, over their length; standard_rate: of the arrays themselves, over the expected length; silent_share: of frames whose best
    phone is silence; count_ratio: phones found to phones expected. Without any phone found the rates are null.
    """
    listed = lambda o, c: F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda x: x[c].cast("string"))
    found = posterior_runs(frames, least, silence).groupBy("rec_id").agg(listed("run", "phone").alias("found"))
    goal = expected.groupBy("rec_id").agg(listed("pos", "phone_id").alias("goal"))
    still = frames.groupBy("rec_id").agg(F.avg((argmax_phone(F.col("probs")) == silence).cast("double")).alias("silent_share"))
    rows = goal.join(still, "rec_id", "left").join(found, "rec_id", "left").withColumn("z", align(F.col("goal"), F.col("found")))
    rate = edit_distance(F.col("z.a"), F.col("z.b")) / F.size("z.a")
    standard = edit_distance(F.col("goal"), F.col("found")) / F.size("goal")
    return rows.select("rec_id", rate.alias("error_rate"), standard.alias("standard_rate"), "silent_share", (F.coalesce(F.size("found"), F.lit(0)) / F.size("goal")).alias("count_ratio"))


def cluster_contrast(rows: DataFrame, accepted: dict[str, list[str]], endings: dict[str, list[str]], position: str = "end", step: float = 0.02, single: list[int] | None = None) -> DataFrame:
    """``rec_id, detection``: what is found in place of a target cluster, at the ``end`` or ``start`` of its syllable.

    rows: the segments of a syllable aligned with its basis in place of the target: ``rec_id, segments`` (array of
    ``found, start, end, probs`` in order), ``truth`` (the target and the phone beside it, without stress), ``syllable`` (as it was),
    ``target`` (array of phones) and ``n_basis``. Silence and segments of one frame go; the outer n + 1 are kept, repeats collapse; phones accepted for a
    target become it; what equals the syllable's own edge, or is accepted for the whole ending, becomes the target.
    single: for a basis of one phone, the ids its outermost segment is decided among, by probability.
    """
    kept = F.filter("segments", lambda s: (s["found"] != "[SIL]") & (F.round(s["end"] - s["start"], 6) > step))
    rows = rows.withColumn("__k", kept)
    found = F.transform("__k", lambda s: F.regexp_replace(s["found"], "[012]$", ""))
    if single is not None:
        last = F.size("__k") - 1 if position == "end" else F.lit(0)
        allowed = F.array(*map(F.lit, single))
        best = lambda p: F.array_position(F.transform(p, lambda x, i: F.when(F.array_contains(allowed, i), x).otherwise(0.0)), F.array_max(F.transform(p, lambda x, i: F.when(F.array_contains(allowed, i), x).otherwise(0.0)))) - 1
        found = F.transform("__k", lambda s, i: F.when((i == last) & (F.col("n_basis") == 1), F.get("names", best(s["probs"]).cast("int"))).otherwise(F.regexp_replace(s["found"], "[012]$", "")))
    rows = rows.withColumn("__f", found)
    n = F.least(F.col("n_basis") + 1, F.size("__f"))
    rows = rows.withColumn("__t", collapse_runs(F.slice("__f", F.size("__f") - n + 1 if position == "end" else F.lit(1), n)))
    table = F.create_map(*[x for t, ps in accepted.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    mended = F.zip_with("__t", "truth", lambda p, g: F.when(F.coalesce(F.array_contains(F.try_element_at(table, g), p), F.lit(False)), g).otherwise(p))
    rows = rows.withColumn("__t", F.when(F.size("__t") == F.size("truth"), mended).otherwise(F.col("__t")))
    body = F.slice("__t", 2, F.greatest(F.size("__t") - 1, F.lit(0))) if position == "end" else F.slice("__t", F.lit(1), F.greatest(F.size("__t") - 1, F.lit(0)))
    rows = rows.withColumn("__d", body)
    bare = F.transform("syllable", lambda p: F.regexp_replace(p, "[012]$", ""))
    edge = F.slice(bare, F.greatest(F.size(bare) - F.size("__d") + 1, F.lit(1)), F.size("__d")) if position == "end" else F.slice(bare, F.lit(1), F.size("__d"))
    plain = F.transform("target", lambda p: F.regexp_replace(p, "[012]$", ""))
    whole = F.create_map(*[x for t, ps in endings.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    fits = F.coalesce(F.array_contains(F.try_element_at(whole, F.array_join(plain, "_")), F.array_join("__d", "_")), F.lit(False))
    same = ((F.size("__d") > 0) & (F.col("__d") == edge)) | (F.col("__d") == plain) | fits
    return rows.select("rec_id", F.array_join(F.when(same, F.col("target")).otherwise(F.col("__d")), "_").alias("detection"))


def all_aspects(vowels: DataFrame, clusters: DataFrame, stress: DataFrame, keys: tuple[str, ...] = ("rec_id", "word", "syllable")) -> DataFrame:
    """Vowels and clusters of each syllable in the order start, middle, end, with the stress of the syllable's vowel and of its word.

    vowels: ``keys, phones, detection``; clusters: the same with ``position`` (empty clusters are left out); stress: ``stress_table``'s columns.
    """
    middle = vowels.select(*keys, "phones", "detection", F.lit("middle").alias("position"))
    both = middle.unionByName(clusters.where("phones <> ''").select(*keys, "phones", "detection", "position"))
    joined = both.join(stress.select(*keys, "score", "word_bit", "sentence_bit"), list(keys), "left")
    return order_positions(joined, list(keys))


def evaluate(selection: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Results of ``scorer`` (a table to a table with the ``key``) on the rows that have all ``needed`` columns, and the rows without a result.

    The second table has ``key`` and ``error``: the first column that is null, or ``no result``.
    """
    lacking = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in needed])
    marked = selection.withColumn("__e", lacking)
    results = marked.where("__e is null").drop("__e").transform(scorer)
    silent = marked.where("__e is null").join(results.select(key).distinct(), key, "left_anti").select(key, F.lit("no result").alias("error"))
    return results, marked.where("__e is not null").select(key, F.col("__e").alias("error")).unionByName(silent)


def token_error_rate(truth: Column, found: Column) -> Column:
    """Edit distance of two token arrays over the longer length, for any alphabet and length: 0 for two empty arrays, null for null."""
    size = F.greatest(F.size(truth), F.size(found))
    return F.when(size > 0, edit_distance(truth, found) / size).when(size == 0, 0.0)


def explode_sequences(df: DataFrame, keys: list[str], vectors: str, step: str, value: str) -> DataFrame:
    """One row for each element of a sequence, with its number from 0."""
    return df.select(*keys, F.posexplode(vectors).alias(step, value))


def complete_classes(probs: Column, n: int) -> Column:
    """A probability vector with zeros for the classes it lacks at its end."""
    return F.concat(probs, F.array_repeat(F.lit(0.0), n - F.size(probs)))


def soft_vote(a: DataFrame, b: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """Weighted mean of two tables of probability vectors."""
    both = a.select(*keys, F.col("probs").alias("x")).join(b.select(*keys, F.col("probs").alias("y")), keys)
    return both.select(*keys, F.zip_with("x", "y", lambda p, q: p * weight + q * (1 - weight)).alias("probs"))


def with_silence(frames: DataFrame, aligned: DataFrame) -> DataFrame:
    """Every frame with its aligned label, or ``[SIL]`` where it was dropped as silence."""
    joined = frames.select("rec_id", "frame_idx").join(aligned, ["rec_id", "frame_idx"], "left")
    return joined.withColumn("label", F.coalesce("label", F.lit("[SIL]")))


def segments(frames: DataFrame, step: float) -> DataFrame:
    """``rec_id, pos``: bounds in frames and seconds, and the mean maximum probability."""
    return frames.groupBy("rec_id", "pos").agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        (F.min("frame_idx") * step).alias("start"),
        ((F.max("frame_idx") + 1) * step).alias("end"),
        F.avg(F.array_max("probs")).alias("p"),
    )


def phone_contrast(probs: Column, target: Column, allowed: list[int], least: float) -> Column:
    """The target if its probability exceeds ``least``; else the best of the allowed phones, or of all if these are all zero."""
    masked = F.transform(probs, lambda p, i: F.when(i.isin(allowed), p).otherwise(0.0))
    best = F.when(F.array_max(masked) > 0, argmax_phone(masked)).otherwise(argmax_phone(probs))
    return F.when(F.get(probs, target.cast("int")) > least, target.cast("long")).otherwise(best)


def rewritten_syllable(syllable: Column, at: Column, found: Column) -> Column:
    """A syllable of phones with the phone at an index replaced by what was found, without stress digits."""
    return F.transform(syllable, lambda p, i: F.regexp_replace(F.when(i == at, found).otherwise(p), "[012]$", ""))


def accept_alternatives(df: DataFrame, accepted: list[tuple[str, str]]) -> DataFrame:
    """A detection that is accepted for its target becomes the target; pairs: (target, detection)."""
    pairs = df.sparkSession.createDataFrame(accepted, "target string, detection string").withColumn("ok", F.lit(True))
    joined = df.join(F.broadcast(pairs), ["target", "detection"], "left")
    return joined.withColumn("detection", F.when(F.col("ok"), F.col("target")).otherwise(F.col("detection"))).drop("ok")


def gate(sound: Column, level: Column, seconds: Column, n_syllables: Column, pitch: Column, quiet: float = 40.0, fast: float = 8.0, slow: float = 1.0) -> Column:
    """Verdict on a recording, the first that applies: empty, no sound, too quiet, too short, too long, no pitch, success."""
    rate = n_syllables / seconds
    return (
        F.when(seconds <= 0, "empty")
        .when(~sound, "no sound")
        .when(level < quiet, "too quiet")
        .when(rate > fast, "too short")
        .when((rate < slow) & (n_syllables > 1), "too long")
        .when(pitch.isNull(), "no pitch")
        .otherwise("success")
    )


def validate(error_rate: Column, n_syllables: Column, usual: float = 0.7, single: float = 0.85) -> Column:
    """Accepted if the error rate is under the bound (another for one syllable); null is rejected."""
    return F.coalesce(error_rate < F.when(n_syllables == 1, single).otherwise(usual), F.lit(False))
