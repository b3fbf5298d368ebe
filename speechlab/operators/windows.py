"""Window operators: runs, sessions, chunks, bands and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlab.operators.ordered import scan
from speechlab.plans.scratch import kept


def _turns(label: str):
    """Whether a row starts a run: nothing before it, another label, or a null (every null is a run of its own)."""

    def flag(before, own):
        return before(label).isNull() | own(label).isNull() | (before(label) != own(label))

    return flag


_SCANNED = ("__before", "__after", "__flags", "__since")


def run_id(df: DataFrame, label: str, part: list[str], order: list[str]) -> DataFrame:
    """``run``: number, from 1, of the run of equal labels a row is in; every null is a run of its own.

    Groups of ``part`` may be of any length (``ordered.scan``), here and in all that stands on runs.
    """
    return scan(df, part, order, [label], _turns(label)).withColumn("run", F.col("__flags")).drop(*_SCANNED)


def dedupe_runs(df: DataFrame, label: str, part: list[str], order: list[str]) -> DataFrame:
    """The first row of each run of equal labels."""
    return scan(df, part, order, [label], _turns(label)).where("__since = 0").drop(*_SCANNED)


def _goes_on(label: str) -> Column:
    return F.coalesce(F.col(f"__after.{label}") == F.col(label), F.lit(False))


def run_edges(df: DataFrame, label: str, part: list[str], order: list[str]) -> DataFrame:
    """The first and last rows of each run."""
    rows = scan(df, part, order, [label], _turns(label))
    return rows.where((F.col("__since") == 0) | ~_goes_on(label)).drop(*_SCANNED)


def resolve_overlaps(df: DataFrame, part: list[str], order: list[str], end: str = "end") -> DataFrame:
    """Rows whose end is the smallest of their own and all later ends."""
    # from the end: a frame that only grows is walked through once
    w = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__least", F.min(end).over(w)).where(F.col(end) == F.col("__least")).drop("__least")


def sessionize(df: DataFrame, gap: float, part: list[str], order: list[str]) -> DataFrame:
    """Phrases: rows apart by a silence over ``gap`` seconds start a new one; text, bounds and size of each.

    Files may be of any length; a phrase has to fit a task.
    """
    rows = scan(df, part, order, ["start", "end"], lambda before, own: own("start") - before("end") > gap).withColumn("phrase", F.col("__flags"))
    words = F.transform(F.array_sort(F.collect_list(F.struct(*order, "word"))), lambda x: x["word"])
    return rows.groupBy(*part, "phrase").agg(F.array_join(words, " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words"))


def segment_numbers(df: DataFrame, label: str, part: list[str], order: list[str]) -> DataFrame:
    """``run``, and ``segment``: number, from 0, within each run of equal labels."""
    return scan(df, part, order, [label], _turns(label)).withColumn("run", F.col("__flags")).withColumn("segment", F.col("__since").cast("int")).drop(*_SCANNED)


def segment_names(df: DataFrame, label: str, part: list[str], order: list[str], extension: str = ".wav") -> DataFrame:
    """``name``: base name of the label's file, then the segment's number within its run, for the clip that is cut out."""
    base = F.regexp_replace(F.element_at(F.split(label, "/"), -1), r"\.[^.]*$", "")
    rows = segment_numbers(df, label, part, order)
    return rows.withColumn("name", F.concat(base, F.lit("_"), F.col("segment").cast("string"), F.lit(extension)))


def top_binary(df: DataFrame, part: list[str], score: str, order: str, share: int = 3, least: float = 60.0) -> DataFrame:
    """``bit``: 1 for the highest ceil(n / share) scores of a chunk that reach ``least``; a chunk of one is always 1."""
    w = Window.partitionBy(*part)
    rank = F.row_number().over(w.orderBy(F.desc(score), order))
    n = F.count("*").over(w)
    top = (rank <= F.ceil(n / share)) & (F.col(score) >= least)
    return df.withColumn("bit", ((n == 1) | top).cast("int"))


def minmax(df: DataFrame, col: str, part: list[str]) -> DataFrame:
    """``scaled``: 0 to 1 within a partition; 0 where all values are equal."""
    w = Window.partitionBy(*part)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn("scaled", F.when(high > low, (F.col(col) - low) / (high - low)).otherwise(0.0))


def frequency_band(words: DataFrame, low: float, high: float) -> DataFrame:
    """``word, n, percent``: words whose cumulative share, from the most frequent on, lies between the bounds.

    The running sum goes over distinct counts, few of them, not over words; words of one count share it.
    """
    counts = kept(words.groupBy("word").agg(F.count("*").alias("n")))  # read twice: tokens are not
    steps = counts.groupBy("n").agg(F.sum("n").alias("mass"))
    running = steps.withColumn("above", F.sum("mass").over(Window.orderBy(F.desc("n")))).withColumn("total", F.sum("mass").over(Window.partitionBy()))
    shares = running.select("n", (F.lit(100.0) * F.col("above") / F.col("total")).alias("percent"))
    return counts.join(shares, "n").where((F.col("percent") > low) & (F.col("percent") < high)).select("word", "n", "percent")


def cap_per_class(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each class, by the md5 of the key."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def next_word_filter(df: DataFrame, part: list[str], order: list[str], starts: str) -> DataFrame:
    """Rows whose next word does not start so."""
    ahead = F.lead("word").over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn("__next", ahead).where(F.col("__next").isNull() | ~F.col("__next").startswith(starts)).drop("__next")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def word_stress_bins(df: DataFrame, part: list[str], score: str, order: str) -> DataFrame:
    """``bit``: 1 for the first maximum of each word."""
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(score), order))
    return df.withColumn("bit", (rank == 1).cast("int"))


def stress_score(df: DataFrame, part: list[str], features: dict[str, float]) -> DataFrame:
    """``score``: weighted mean, in percent, of features scaled within a partition; weights by column."""
    out = df
    for c in features:
        out = minmax(out, c, part).withColumnRenamed("scaled", f"__{c}")
    total = sum(F.col(f"__{c}") * w for c, w in features.items()) / sum(features.values())
    return out.withColumn("score", F.floor(F.round(total * 100, 6)).cast("long")).drop(*[f"__{c}" for c in features])


def phrase_ids(df: DataFrame, label: str, part: list[str], order: list[str]) -> DataFrame:
    """``phrase_id``: label and position, from 1, in its run of equal labels."""
    rows = segment_numbers(df, label, part, order)
    return rows.withColumn("phrase_id", F.concat_ws("_", label, F.col("run").cast("string"), (F.col("segment") + 1).cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The first ``n`` rows in the order of the md5 of key and seed (a sampling operator)."""
    return df.withColumn("__h", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)))).orderBy("__h", key).limit(n).drop("__h")


def user_panel(df: DataFrame, user: str, key: str, n_users: int, cap: int) -> DataFrame:
    """At most ``cap`` rows of each of the first ``n_users`` users."""
    users = df.select(user).distinct().orderBy(user).limit(n_users)
    return cap_per_class(df.join(F.broadcast(users), user, "left_semi"), user, key, cap)


def run_blocks(df: DataFrame, label: str, part: list[str], order: list[str]) -> DataFrame:
    """Rows inside runs of two or more equal labels."""
    rows = scan(df, part, order, [label], _turns(label))
    return rows.where((F.col("__since") > 0) | _goes_on(label)).drop(*_SCANNED)


def order_positions(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """``place``: number, from 0, in the order of keys and start, middle, end within the last key's group."""
    rank = F.when(F.col(position) == "start", 0).when(F.col(position) == "middle", 1).when(F.col(position) == "end", 2).otherwise(3)
    return df.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(rank)) - 1).cast("long"))


def stress_table(syllables: DataFrame, key: str = "rec_id") -> DataFrame:
    """``word_bit`` and ``sentence_bit`` of each stressed-vowel row (``key, chunk, word, syllable, score``).

    word_bit: 1 for the first maximum of a word. sentence_bit: of a word's highest score, 1 if it is among the top third of its
    chunk (at least one) and at least 60; a chunk of one word is always 1. A recording of one vowel has score 100 and ones.
    """
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    rows = syllables.withColumn("__one", alone).withColumn("score", F.when(F.col("__one"), 100).otherwise(F.col("score")))
    rows = word_stress_bins(rows, [key, "word"], "score", "syllable").withColumnRenamed("bit", "word_bit")
    # the syllables of a word share its rank among the words of its chunk, so one more sort of the same parts gives it to all of them
    rows = rows.withColumn("__top", F.max("score").over(Window.partitionBy(key, "word")))
    chunk = Window.partitionBy(key, "chunk")
    rows = rows.withColumn("__rank", F.dense_rank().over(chunk.orderBy(F.desc("__top"), "word")))
    n = F.max("__rank").over(chunk)
    top = (F.col("__rank") <= F.ceil(n / 3)) & (F.col("__top") >= 60.0)
    rows = rows.withColumn("sentence_bit", ((n == 1) | top).cast("int"))
    return rows.where(F.col(key).isNotNull() & F.col("word").isNotNull()).drop("__one", "__top", "__rank")
