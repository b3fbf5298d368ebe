"""Shares, confusions and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlab.functions.phonetics import collapse_runs
from speechlab.operators.ordered import dealt, scan


def value_percent(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    counts = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def confusion_matrix(df: DataFrame, alphabet: list[str]) -> DataFrame:
    """Row shares over a fixed alphabet, zero cells kept; rows of a target that is absent are 0."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in alphabet for b in alphabet], "target string, detection string")
    counts = df.groupBy("target", "detection").agg(F.count("*").alias("n"))
    full = F.broadcast(cells).join(counts, ["target", "detection"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("target"))
    return full.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def success_rate(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("detection") == F.col("target")).cast("double")).alias("rate"))


def rejection_report(df: DataFrame, by: list[str], accepted, correct) -> DataFrame:
    """Counts and percentages of false acceptances and false rejections."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(accepted & ~correct).alias("false_accept"),
        F.count_if(~accepted & correct).alias("false_reject"),
    )
    for c in ("false_accept", "false_reject"):
        out = out.withColumn(f"{c}_percent", F.lit(100.0) * F.col(c) / F.col("n"))
    return out


def histogram(df: DataFrame, col: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of equal bins; the upper bound belongs to the last."""
    bin_of = F.least(F.floor((F.col(col) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    return df.where((F.col(col) >= low) & (F.col(col) <= high)).groupBy(*by, bin_of.alias("bin")).agg(F.count("*").alias("n"))


def frequent_words(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words with their percentage (a top-n report)."""
    counts = df.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "word").limit(n)
    return top.join(F.broadcast(total)).select("word", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))


def drop_top_words(df: DataFrame, k: int) -> DataFrame:
    top = df.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k).select("word")
    return df.join(F.broadcast(top), "word", "left_anti")


def threshold_sweep(df: DataFrame, score: str, positive) -> DataFrame:
    """True and false positive rates of accepting scores up to each distinct value; sums run over distinct scores.

    Scores are dealt by range over stored partitions, and sums within a range start from those of all ranges before it:
    no task takes more than its range, also where scores hardly repeat. Without a positive (a negative) row ``tpr`` (``fpr``) is null.
    """
    steps = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    rows = dealt(steps, ["threshold"])
    of = Window.partitionBy("part").orderBy("threshold")
    run = rows.withColumn("cp", F.sum("p").over(of)).withColumn("cq", F.sum("q").over(of))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    every = Window.partitionBy()
    sums = rows.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    base = sums.select("part", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in "pq"], *[F.sum(f"s{k}").over(every).alias(f"t{k}") for k in "pq"])
    joined = run.join(F.broadcast(base), "part")
    return joined.select("threshold", F.try_divide(F.col("cp") + F.col("bp"), "tp").alias("tpr"), F.try_divide(F.col("cq") + F.col("bq"), "tq").alias("fpr"))


def mean_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, pos, mean``: mean vector of each label, component by component."""
    return df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def compare_models(df: DataFrame, baseline: str, slack: float) -> DataFrame:
    """Models, except the baseline, each of whose rates is at least the baseline's less ``slack`` points."""
    base = df.where(F.col("model") == baseline).select("target", F.col("rate").alias("base_rate"))
    joined = df.where(F.col("model") != baseline).join(base, "target")
    return joined.groupBy("model").agg(F.bool_and(F.col("rate") >= F.col("base_rate") - slack).alias("holds"), F.count("*").alias("n_targets"))


def confusion(df: DataFrame, detections: list[str]) -> DataFrame:
    """Share of each detection in a target's rows, one column for each of the given detections."""
    wide = df.groupBy("target").pivot("detection", detections).count().fillna(0, detections)
    total = sum(F.col(d) for d in detections)
    return wide.select("target", *[F.when(total > 0, F.col(d) / total).otherwise(0.0).alias(f"share_{d.lower()}") for d in detections])


def posterior_matrix(frames: DataFrame, label: str) -> DataFrame:
    """``label, phone, share``: probability vectors summed for each label, as shares of the label's sum (0 where that is 0)."""
    sums = frames.select(label, F.posexplode("probs").alias("phone", "p")).groupBy(label, "phone").agg(F.sum("p").alias("s"))
    total = F.sum("s").over(Window.partitionBy(label))
    return sums.select(label, "phone", F.when(total == 0, 0.0).otherwise(F.try_divide("s", total)).alias("share"))


def weighted_confidence(segments: DataFrame, by: list[str], p: str, n: str) -> DataFrame:
    """``weighted, total, confidence``: sums of ``p * n`` and of durations ``n``, and their ratio, null where the total is zero.

    Whole or decimal columns are summed exactly and divided once.
    """
    sums = segments.groupBy(*by).agg(F.sum(F.col(p) * F.col(n)).alias("weighted"), F.sum(n).alias("total"))
    return sums.withColumn("confidence", F.try_divide(F.col("weighted").cast("double"), F.col("total").cast("double")))


def truth_stats(frames: DataFrame, true_id, silence: int) -> DataFrame:
    """``rec_id, mean, median, match_rate``: the true phone's probability and how often it is the maximum; silence rows are left out."""
    kept = frames.where(true_id != silence).withColumn("p", F.get("probs", true_id.cast("int")))
    hit = (F.array_position("probs", F.array_max("probs")) - 1 == true_id).cast("double")
    return kept.groupBy("rec_id").agg(F.avg("p").alias("mean"), F.median("p").alias("median"), F.avg(hit).alias("match_rate"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def rates_by(df: DataFrame, group, hit) -> DataFrame:
    """``speaker, n, rate`` for a speaker expression and a success expression."""
    return df.groupBy(group.alias("speaker")).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))


def error_ranking(df: DataFrame, by: list[str], wrong) -> DataFrame:
    """``by, n_errors, n, share``: errors of each group, most first, and (in every row) the share of errors in all rows."""
    counts = df.groupBy(*by).agg(F.count_if(wrong).alias("n_errors"), F.count("*").alias("n"))
    total = counts.agg((F.sum("n_errors") / F.sum("n")).alias("share"))
    return counts.where("n_errors > 0").join(F.broadcast(total), F.lit(True), "left").orderBy(F.desc("n_errors"), *by)


def mismatched_truth_stats(frames: DataFrame, true_id, silence: int) -> DataFrame:
    """As ``truth_stats``, with each recording's labels beside the frames of the next one (a control): ``rec_id, mean, median``.

    Recordings are paired in the order of their ids, the last with the first.
    """
    ids = scan(frames.select("rec_id").distinct(), [], ["rec_id"], ["rec_id"], lambda before, own: F.lit(False))
    first = frames.agg(F.min("rec_id").alias("first"))  # one row
    pairs = ids.join(F.broadcast(first)).select(F.col("rec_id").alias("a"), F.coalesce("__after.rec_id", "first").alias("b"))
    labels = frames.select("rec_id", "frame_idx", true_id.alias("__t")).join(pairs, F.col("rec_id") == F.col("a")).select("b", "frame_idx", "__t")
    rows = frames.select(F.col("rec_id").alias("b"), "frame_idx", "probs").join(labels, ["b", "frame_idx"]).where(F.col("__t") != silence)
    p = F.get("probs", F.col("__t").cast("int"))
    return rows.groupBy(F.col("b").alias("rec_id")).agg(F.avg(p).alias("mean"), F.median(p).alias("median"))


def match_rates(segments: DataFrame, keys: list[str], silence: str = "[SIL]") -> DataFrame:
    """``n_phones, phone_rate, n_syllables, syllable_rate`` of a segment table (``keys`` of a syllable, ``pos, phone, found``).

    A phone found as silence is no error; a syllable matches if its found phones, without silence and repeats of
    neighbours, are its phones.
    """
    wrong = (F.col("phone") != F.col("found")) & (F.col("found") != silence)
    order = F.array_sort(F.collect_list(F.struct("pos", "phone", "found")))
    whole = segments.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(wrong).alias("bad"), order.alias("r"))
    heard = collapse_runs(F.filter(F.transform("r", lambda x: x["found"]), lambda t: t != silence))
    hit = (heard == F.transform("r", lambda x: x["phone"])).cast("double")
    return whole.agg(F.sum("n").alias("n_phones"), (1 - F.try_divide(F.sum("bad"), F.sum("n"))).alias("phone_rate"), F.count("*").alias("n_syllables"), F.avg(hit).alias("syllable_rate"))


def sentence_stress_eval(df: DataFrame) -> DataFrame:
    """One row: how well stress is found inside the chunk that holds the stressed word.

    df: ``bins`` and ``found`` (0/1 for each word) and ``counts`` (words of each chunk). Sentences without exactly one
    stressed word are left out. ``base_rate, found_rate``: shares of ones in these chunks; ``failure_rate``: chunks without
    any result; ``hit_rate``: of the others, those where the stressed word is found. A rate of nothing is null.
    """
    one = df.where(F.size(F.filter("bins", lambda b: b == 1)) == 1).withColumn("__at", F.array_position("bins", 1) - 1)
    ends = F.transform("counts", lambda c, k: F.aggregate(F.slice("counts", F.lit(1), k + 1), F.lit(0), lambda a, v: a + v.cast("int")))
    chunk = F.filter(F.transform(ends, lambda e, k: F.struct((e - F.get("counts", k)).cast("int").alias("a"), e.cast("int").alias("e"))), lambda x: (F.col("__at") >= x["a"]) & (F.col("__at") < x["e"]))
    one = one.withColumn("__c", F.get(chunk, F.lit(0))).where("__c is not null")
    cut = lambda c: F.slice(c, F.col("__c.a") + 1, F.col("__c.e") - F.col("__c.a"))
    rows = one.select(cut("bins").alias("b"), cut("found").alias("f"), (F.get("found", F.col("__at").cast("int")) == 1).alias("hit"))
    ones = lambda c: F.try_divide(F.sum(F.size(F.filter(c, lambda b: b == 1))), F.sum(F.size(c)))
    empty = F.size("f") == 0
    hit = F.avg(F.when(~empty, F.coalesce(F.col("hit"), F.lit(False)).cast("double")))
    return rows.agg(F.count("*").alias("n"), ones("b").alias("base_rate"), ones("f").alias("found_rate"), F.avg(empty.cast("double")).alias("failure_rate"), hit.alias("hit_rate"))


def word_stress_eval(df: DataFrame) -> DataFrame:
    """``n_syll, n, error``: share of wrong stress bits by the word's length in syllables.

    df: ``truth`` and ``found`` (0/1 for each syllable) of each word. Words of several syllables that are all stressed, and
    words whose lengths differ, are left out.
    """
    usual = (F.size("truth") == 1) | F.array_contains("truth", 0)
    rows = df.where(usual & (F.size("truth") == F.size("found")))
    wrong = rows.select(F.size("truth").cast("long").alias("n_syll"), F.explode(F.zip_with("truth", "found", lambda x, y: (x != y).cast("double"))).alias("bad"))
    return wrong.groupBy("n_syll").agg(F.count("*").alias("n"), F.avg("bad").alias("error"))


def syllable_set(phonetics: DataFrame, col: str = "phonetics") -> DataFrame:
    """Distinct syllables of formatted phonetics."""
    return phonetics.select(F.explode(F.split(col, r"[ |]")).alias("syllable")).distinct()


def classifier_scores(df: DataFrame) -> DataFrame:
    """``model, accuracy, accuracy_unstressed`` of ``model, phone, guess`` rows."""
    bare = lambda c: F.regexp_replace(c, "[012]$", "")
    equal, loose = F.col("phone") == F.col("guess"), bare("phone") == bare("guess")
    return df.groupBy("model").agg(F.avg(equal.cast("double")).alias("accuracy"), F.avg(loose.cast("double")).alias("accuracy_unstressed"))


def word_score_arrays(scores: DataFrame, paths: list[tuple[str, DataFrame]]) -> DataFrame:
    """``sentence_id, text, total, words_accuracy, words_stress, words_phones, wav_path, data_set``.

    scores: ``sentence_id`` and ``json``, an object with ``text``, ``total`` and ``words`` (objects with ``accuracy``, ``stress``, ``phones``);
    paths: (data set, its ``sentence_id, wav_path``). What cannot be parsed has nulls; sentences without a path stay.
    """
    shape = "text string, total double, words array<struct<accuracy: double, stress: double, phones: array<string>>>"
    parsed = scores.select("sentence_id", F.from_json("json", shape).alias("s"))
    known = reduce(DataFrame.unionByName, [df.select("sentence_id", "wav_path").withColumn("data_set", F.lit(name)) for name, df in paths])
    field = lambda n: F.transform("s.words", lambda w: w[n]).alias(f"words_{n}")
    return parsed.select("sentence_id", "s.text", "s.total", field("accuracy"), field("stress"), field("phones")).join(known, "sentence_id", "left")


def answer_scores(answers: DataFrame, key: DataFrame) -> DataFrame:
    """``student, n_items, score``: items whose stressed place (the first 1 of ``bins``, from 1; null without any) is the key's.

    answers: ``student, item, bins``; key: ``item, place``. Items without a key do not count.
    """
    place = F.nullif(F.array_position("bins", 1), F.lit(0))
    rows = answers.select("student", "item", place.alias("given")).join(F.broadcast(key.select("item", "place")), "item")
    return rows.groupBy("student").agg(F.count("*").alias("n_items"), F.count_if(F.col("given") == F.col("place")).alias("score"))
