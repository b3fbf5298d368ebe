"""Interval joins, exclusions and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.functions.text import focus_bins
from speechlab.operators.alignment import GAP, align
from speechlab.operators.windows import first_per_key

#: Expected phonetics that a task holds beside a recording, about.
GRID = 10_000
#: Seconds of a time bucket: intervals meet only within a bucket of a file, so a long file is spread.
BUCKET = 600.0


def overlap_join(words: DataFrame, phones: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """``file_id, word_id, k_word, phone, p_start`` for each word and phone of a file that overlap in time.

    Both sides are dealt to the time buckets they touch; a pair counts in the bucket where its overlap starts.
    """

    def dealt(df: DataFrame) -> DataFrame:
        ids = F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))
        return df.withColumn("bucket", F.explode(ids))

    w, p = dealt(words).alias("w"), dealt(phones).alias("p")
    meet = (F.col("w.file_id") == F.col("p.file_id")) & (F.col("w.bucket") == F.col("p.bucket"))
    meet = meet & (F.col("w.start") < F.col("p.end")) & (F.col("p.start") < F.col("w.end"))
    own = F.floor(F.greatest(F.col("w.start"), F.col("p.start")) / bucket) == F.col("w.bucket")
    return w.join(p, meet & own).select("w.file_id", "w.word_id", F.col("p.word_id").alias("from_word"), "p.k", "p.phone", F.col("p.start").alias("p_start"))


def phones_of_words(words: DataFrame, phones: DataFrame) -> DataFrame:
    """``file_id, word_id, phones``: the overlapping phones of each word in time order."""
    order = F.array_sort(F.collect_list(F.struct("p_start", "from_word", "k", "phone")))
    return overlap_join(words, phones).groupBy("file_id", "word_id").agg(F.array_join(F.transform(order, lambda x: x["phone"]), "_").alias("phones"))


def label_frames(frames: DataFrame, intervals: DataFrame, step: float, silence: str | None = None) -> DataFrame:
    """Frames with the label of the interval ``[int(start / step), int(end / step))`` they are in: an equi-join on frame numbers.

    silence: also the frames before a recording's first interval, under this label.
    """
    numbers = F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step) - 1)
    spread = intervals.where(F.floor(F.col("end") / step) > F.floor(F.col("start") / step)).select("rec_id", "phone", F.explode(numbers).alias("frame_idx"))
    if silence is not None:
        first = intervals.groupBy("rec_id").agg(F.floor(F.min("start") / step).alias("first")).where("first > 0")
        lead = first.select("rec_id", F.lit(silence).alias("phone"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("first") - 1)).alias("frame_idx"))
        spread = spread.withColumn("phone", F.col("phone").cast("string")).unionByName(lead)
    return frames.join(spread, ["rec_id", "frame_idx"])


def attach_alignments(metadata: DataFrame, alignments: DataFrame, name: str, file: str, extension: str) -> DataFrame:
    """Metadata rows that have an alignment, with it; an alignment's ``file`` is the metadata's name and the extension."""
    return metadata.withColumn(file, F.concat(name, F.lit(extension))).join(alignments, file)


def sentence_phonetics(words: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``file_id, phonetics``: the phones of each file's words in their places, the first of several rows (by ``order``) of a place and word; empty where null.

    parts: tasks that the files are dealt to (see ``tasks_for``).
    """
    dealt = words.repartition(parts, "file_id") if parts else words.repartition("file_id")
    first = first_per_key(dealt, ["file_id", "word_idx", "word"], order)
    rows = first.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", F.coalesce("phones", F.lit("")).alias("p")))).alias("r"))
    return rows.select("file_id", F.array_join(F.transform("r", lambda x: x["p"]), " ").alias("phonetics"))


def pair_labels(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``truth`` and ``found`` arrays of the same key, where their lengths are equal."""
    return truth.join(found, key).where(F.size("truth") == F.size("found"))


def attach_paths(metadata: DataFrame, files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Rows with the path whose base name, without its extension, is their key; rows without a file go."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return metadata.join(files.select(F.col(path), base.alias(key)), key)


def adversary_grid(recordings: DataFrame) -> DataFrame:
    """Each recording (``rec, phonetics, alt_phonetics, target``) beside every distinct expected phonetics that is not empty.

    ``match``: it is the recording's own or its alternative; ``should_reject``: the recording is no target, or does not match.
    The expected ones are a content list: up to ``GRID`` of them are broadcast; a longer one is cut into lists of about so many,
    each recording goes to a task of every list, and a list to as many tasks as a shuffle has.
    """
    expected = recordings.where("phonetics <> ''").select(F.col("phonetics").alias("expected")).distinct()
    if expected.limit(GRID + 1).count() <= GRID:
        listed = expected.groupBy().agg(F.collect_set("expected").alias("all"))
        rows = recordings.join(F.broadcast(listed), F.lit(True), "inner")
    else:
        lists, tasks = -(-expected.count() // GRID), int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        listed = expected.groupBy(F.pmod(F.xxhash64("expected"), F.lit(lists)).cast("int").alias("__list")).agg(F.collect_set("expected").alias("all"))
        listed = listed.withColumn("__task", every(tasks))
        rows = recordings.withColumn("__task", F.pmod(F.xxhash64("rec"), F.lit(tasks)).cast("int")).withColumn("__list", every(lists))
        rows = rows.join(listed, ["__list", "__task"]).drop("__list", "__task")
    rows = rows.withColumn("expected", F.explode("all")).drop("all")
    match = F.coalesce((F.col("expected") == F.col("phonetics")) | (F.col("expected") == F.col("alt_phonetics")), F.lit(False))
    return rows.withColumn("match", match).withColumn("should_reject", ~F.col("target") | ~F.col("match"))


def attach_phrases(files: DataFrame, order: DataFrame, phrases: DataFrame) -> DataFrame:
    """``path, number, id, text, bins``: the number at the end of a file's base name is a place in ``order`` (``number, id``), whose id has a phrase."""
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"([0-9]+)\.[^.]*$", 1).try_cast("bigint")
    rows = files.select("path", number.alias("number")).join(order.select("number", "id"), "number").join(phrases.select("id", "text"), "id")
    return rows.select("path", "number", "id", "text", focus_bins(F.col("text")).alias("bins"))


def transfer_index(rows: DataFrame) -> DataFrame:
    """``index, status`` of a target phone in another transcription, through a global alignment of the two.

    rows: ``phonetics`` (formatted), ``word_idx``, ``target``, ``others`` (an array of phones; null: its alignment failed).
    The target's first place in its word is counted to a place in the whole, found in the alignment, and counted back
    in the other transcription without its gaps. Another stress, or AA for AO, still is success.
    """
    flat = lambda c: F.split(F.regexp_replace(c, "[-|]", "_"), "[ _]")
    word = F.get(F.split("phonetics", " "), F.col("word_idx"))
    before = F.array_join(F.slice(F.split("phonetics", " "), F.lit(1), F.col("word_idx")), " ")
    inside = F.array_position(flat(word), F.col("target"))
    out = rows.withColumn("__at", F.when(inside > 0, inside - 1 + F.when(F.col("word_idx") > 0, F.size(flat(before))).otherwise(0)))
    out = out.withColumn("__z", align(flat(F.col("phonetics")), F.col("others")))
    places = F.filter(F.transform("__z.a", lambda t, i: F.when(t != GAP, i)), lambda i: i.isNotNull())
    out = out.withColumn("__i", F.get(places, F.col("__at").cast("int")))
    out = out.withColumn("__j", F.col("__i") - F.size(F.filter(F.slice("__z.b", F.lit(1), F.col("__i")), lambda t: t == GAP)))
    found = F.get("others", F.col("__j"))
    bare = lambda c: F.regexp_replace(c, "[012]$", "")
    same = (bare(found) == bare(F.col("target"))) | (bare(found).isin("AA", "AO") & bare(F.col("target")).isin("AA", "AO"))
    status = (
        F.when(F.col("others").isNull(), "error: alignment failure")
        .when(F.col("__at").isNull(), "error: target phoneme not in word")
        .when(found.isNull(), "error: phonetization or alignment problem")
        .when(same, "success")
        .otherwise(F.concat(F.lit("error: it is instead: "), found))
    )
    index = F.when(status == "success", F.col("__j").cast("long"))
    return out.withColumn("index", index).withColumn("status", status).drop("__at", "__z", "__i", "__j")


def exclude_files(df: DataFrame, key: str, marker) -> DataFrame:
    """Rows of files that hold no row with the marker."""
    return df.join(df.where(marker).select(key).distinct(), key, "left_anti")


def new_phrases(content: DataFrame, catalogue: DataFrame, text, key: str) -> DataFrame:
    """Rows with a normalised text that the catalogue lacks, the first of equal ones (by ``key``)."""
    own = content.withColumn("norm", text(F.col("text"))).groupBy("norm").agg(F.min(key).alias(key))
    return own.join(catalogue.select(text(F.col("text")).alias("norm")).distinct(), "norm", "left_anti")


def enrich(rows: DataFrame, attributes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their attributes, and the rows whose key is unknown."""
    return rows.join(attributes, key), rows.join(attributes, key, "left_anti")


def inflection_pairs(words: DataFrame, lexicon: DataFrame, suffix: str, sounds: tuple[str, ...] | None = None) -> DataFrame:
    """``base, inflected``: both are words of the lexicon and of the corpus.

    sounds: the first alternative of the inflected word ends in one of these phones, and the base's does not.
    """
    known = words.select("word").distinct().join(lexicon.select("word").distinct(), "word", "left_semi")
    base = known.select(F.col("word").alias("base"), F.concat("word", F.lit(suffix)).alias("inflected"))
    pairs = base.join(known.select(F.col("word").alias("inflected")), "inflected")
    if sounds is None:
        return pairs
    last = lexicon.where("alt_idx = 0").select("word", F.element_at(F.split("phones", "_"), -1).isin(*sounds).alias("hit"))
    pairs = pairs.join(last.where("hit").select(F.col("word").alias("inflected")), "inflected")
    return pairs.join(last.where("not hit").select(F.col("word").alias("base")), "base").select("base", "inflected")


def stem_semi(words: DataFrame, ends: DataFrame) -> DataFrame:
    """Words whose stem, one or two characters shorter, is among ``ends``."""
    stems = words.select("word").distinct().select("word", F.explode(F.array(F.expr("left(word, length(word) - 1)"), F.expr("left(word, length(word) - 2)"))).alias("stem"))
    return stems.join(ends.select(F.col("word").alias("stem")).distinct(), "stem", "left_semi").select("word").distinct()
