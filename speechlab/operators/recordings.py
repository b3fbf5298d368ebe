"""Whole jobs over recordings: a frame classifier, the analysis of learners' recordings, and a corpus from texts to aligned segments.

Each puts operators of ``classifiers``, ``alignment``, ``frames``, ``windows`` and ``phonetize`` in a row; tables that
several steps read are stored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlab.functions import phonetics as P
from speechlab.operators import alignment as A
from speechlab.operators import classifiers as C
from speechlab.operators import frames as K
from speechlab.operators import phonetize as Z
from speechlab.operators import windows as W
from speechlab.plans.scratch import kept

SILENCE = "[SIL]"


class FrameClassifier(NamedTuple):
    """A fitted reduction, the reduced training frames (``id, label, v``), the order of phones, and the number of neighbours."""

    reduction: tuple
    train: DataFrame
    alphabet: list[str]
    k: int


def fit_frame_classifier(frames: DataFrame, alphabet: list[str], k: int = 10, variance: float = 0.95, cap: int = 500) -> FrameClassifier:
    """Principal components that keep ``variance``, and at most ``cap`` training frames of each phone, reduced.

    frames: ``id`` (a number), ``phone`` and ``vector``; phones outside the alphabet are left out.
    """
    known = W.cap_per_class(frames.where(F.col("phone").isin(alphabet)).select("id", "phone", "vector"), "phone", "id", cap)
    known = kept(known)
    reduction = C.fit_pca(known, variance)
    train = kept(C.reduce_frames(known, reduction).select("id", F.col("phone").alias("label"), F.col("vector").alias("v")))
    return FrameClassifier(reduction, train, alphabet, k)


def phone_probabilities(frames: DataFrame, model: FrameClassifier, keys: tuple[str, ...] = ("rec_id", "frame_idx"), metric: str = "euclidean", weights: str = "distance") -> DataFrame:
    """``keys, probs``: each frame's probabilities in the order of the alphabet, 0 for phones among no neighbour.

    frames: ``keys`` (together unique) and ``vector``; frames without a finite vector are left out.
    """
    reduced = C.reduce_frames(frames.select(*keys, "vector"), model.reduction)
    near = A.knn_probabilities(model.train, reduced.select(F.struct(*keys).alias("id"), F.col("vector").alias("v")), model.k, metric, weights)
    found = near.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("m"))
    probs = F.transform(F.array(*map(F.lit, model.alphabet)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0)))
    return found.select(*[F.col(f"id.{c}").alias(c) for c in keys], probs.alias("probs"))


class Analysis(NamedTuple):
    """``checks`` (rec_id, status, error_rate, cost), ``segments`` (of accepted recordings) and ``aspects`` of their syllables."""

    checks: DataFrame
    segments: DataFrame
    aspects: DataFrame


def _no_gaps(named: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), named.cast("int"))


def analyse(
    recordings: DataFrame, frames: DataFrame, expected: DataFrame, names: list[str], vowels: list[int], levels: DataFrame | None = None,
    accepted: dict[str, list[str]] | None = None, endings: dict[str, list[str]] | None = None, least: float = 0.6, usual: float = 0.7, single: float = 0.85, step: float = 0.02,
) -> Analysis:
    """The analysis of learners' recordings against the phones that they were to say.

    recordings: ``rec_id, sound, level, seconds, n_syllables, pitch``. frames: ``rec_id, frame_idx, probs`` (the last: silence).
    expected: ``rec_id, pos, phone_id, word, syllable, chunk``. names: phones by id, with their stress off, the last one silence.
    levels: ``rec_id, frame_idx, level`` (loudness; without it stress follows durations alone).

    1. A gate on the sound itself; then the error rate of the phones found against those expected has to be under a bound
       (``usual``; ``single`` for one syllable), else the status is ``no match``.
    2. Accepted recordings are aligned without their silent frames; one with fewer such frames than phones has the
       status ``alignment failed``. Aligned frames are pooled to segments.
    3. Vowels: the expected one if its probability exceeds ``least``, else the best vowel. Clusters before and after the
       first vowel of a syllable: what is found there, with what is accepted in its place (``frames.cluster_contrast``).
    4. Stress: level and length of vowels scaled within the recording; bits of words and of the sentence.

    ``aspects``: ``rec_id, word, syllable, position, phones, detection, score, word_bit, sentence_bit, place``.
    """
    silence = len(names) - 1
    verdict = K.gate(F.col("sound"), F.col("level"), F.col("seconds"), F.col("n_syllables"), F.col("pitch"))
    gated = kept(recordings.select("rec_id", "n_syllables", verdict.alias("status")))
    heard = gated.where("status = 'success'").select("rec_id", "n_syllables")
    own = kept(frames.join(heard.select("rec_id"), "rec_id", "left_semi"))
    goal = kept(expected.join(heard.select("rec_id"), "rec_id", "left_semi"))
    rates = K.recording_check(own, goal, least, silence).select("rec_id", "error_rate")
    rates = kept(heard.join(rates, "rec_id", "left").withColumn("valid", K.validate(F.col("error_rate"), F.col("n_syllables"), usual, single)))
    valid = rates.where("valid").select("rec_id")

    spoken = kept(K.drop_silence(own.join(valid, "rec_id", "left_semi")))
    targets = goal.join(valid, "rec_id", "left_semi")
    aligned = kept(K.force_align(spoken, targets.select("rec_id", "pos", "phone_id")))
    status = (
        F.when(F.col("status") != "success", F.col("status")).when(~F.coalesce("valid", F.lit(False)), "no match")
        .when(F.col("cost").isNull(), "alignment failed").otherwise("success")
    )
    checks = gated.join(rates.drop("n_syllables"), "rec_id", "left").join(aligned.select("rec_id", "cost"), "rec_id", "left")
    checks = checks.select("rec_id", status.alias("status"), "error_rate", "cost")

    path = K.path_rows(aligned, targets).join(spoken.select("rec_id", "t", "frame_idx"), ["rec_id", "t"])
    path = kept(path.select("rec_id", "frame_idx", "pos", "phone_id"))
    pooled = K.pooled_segments(path, spoken, step=step)
    probs = K.pool(K.halve_shared_runs(path).join(spoken.select("rec_id", "frame_idx", "probs"), ["rec_id", "frame_idx"]), ["rec_id", "pos"])
    probs = probs.groupBy("rec_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("phone", "p"))), lambda x: x["p"]).alias("probs"))
    place = targets.select("rec_id", F.col("pos").cast("long").alias("pos"), "word", "syllable", "chunk")
    segments = pooled.join(probs, ["rec_id", "pos"]).join(place, ["rec_id", "pos"])
    if levels is not None:
        loud = path.join(levels.select("rec_id", "frame_idx", "level"), ["rec_id", "frame_idx"]).groupBy("rec_id", "pos").agg(F.avg("level").alias("level"))
        segments = segments.join(loud, ["rec_id", "pos"], "left")
    else:
        segments = segments.withColumn("level", F.lit(0.0))
    segments = segments.withColumn("phone", _no_gaps(F.col("phone_id"), names)).withColumn("found", _no_gaps(F.col("predicted"), names))
    segments = kept(segments.withColumn("is_vowel", F.col("phone_id").isin(vowels)))

    keys = ["rec_id", "word", "syllable"]
    # the first vowel of a syllable parts its clusters
    first = segments.where("is_vowel").groupBy(*keys).agg(F.min("pos").alias("nucleus"))
    nuclei = segments.join(first, keys).where("pos = nucleus")
    heard_vowel = _no_gaps(K.phone_contrast(F.col("probs"), F.col("phone_id"), vowels, least), names)
    vowel_rows = nuclei.select(*keys, F.col("phone").alias("phones"), heard_vowel.alias("detection"))

    syllable = segments.join(first, keys).groupBy(*keys, "nucleus").agg(F.array_sort(F.collect_list(F.struct("pos", "phone", "found", "start", "end", "probs", "is_vowel"))).alias("all"))
    syllable = syllable.withColumn("ahead", F.filter("all", lambda x: x["pos"] < F.col("nucleus"))).withColumn("after", F.filter("all", lambda x: (x["pos"] > F.col("nucleus")) & ~x["is_vowel"]))
    core = F.transform(F.filter("all", lambda x: x["pos"] == F.col("nucleus")), lambda x: x["phone"])
    name = lambda rows: F.transform(rows, lambda x: x["phone"])

    def clusters(side: str, column: str) -> DataFrame:
        rows = syllable.where(F.size(column) > 0).withColumn("target", name(F.col(column)))
        rows = rows.withColumn("truth", F.concat(core, "target") if side == "end" else F.concat("target", core))
        shown = F.transform("all", lambda x: F.struct(x["found"].alias("found"), x["start"].alias("start"), x["end"].alias("end"), x["probs"].alias("probs")))
        rows = rows.select(F.struct(*keys).alias("rec_id"), shown.alias("segments"), "truth", name(F.col("all")).alias("syllable"), "target", F.size("target").alias("n_basis"))
        told = K.cluster_contrast(rows, accepted or {"": [""]}, endings or {"": [""]}, side, step)
        told = told.join(rows.select("rec_id", F.array_join("target", "_").alias("phones")), "rec_id")
        return told.select(*[F.col(f"rec_id.{c}").alias(c) for c in keys], "phones", "detection", F.lit(side).alias("position"))

    both = clusters("start", "ahead").unionByName(clusters("end", "after"))
    lengths = nuclei.select(*keys, "chunk", "level", (F.col("end") - F.col("start")).alias("length"))
    scored = W.stress_score(lengths, ["rec_id"], {"level": 1.0, "length": 1.0} if levels is not None else {"length": 1.0})
    stress = W.stress_table(scored.select("rec_id", "chunk", "word", "syllable", "score"))
    return Analysis(checks, segments, K.all_aspects(vowel_rows, both, stress))


def build_corpus(sentences: DataFrame, frames: DataFrame, lexicon: DataFrame, dictionary: DataFrame, alphabet: list[str], lang: str = "en", mode: str = "CMU", how: str = "mean") -> tuple[DataFrame, DataFrame]:
    """Texts and frames to aligned segments, and the sentences that give none.

    sentences: ``sent_id, text``; frames: ``sent_id, frame_idx, probs`` in the order of ``alphabet`` (phones without stress; the last:
    silence). First table: ``sent_id, pos, phone, found, p_true, p_predicted, n_frames, start, end``. Second: ``sent_id, error``: a
    word without pronunciation, phones outside the alphabet, or fewer frames with speech than phones.
    """
    every = Z.phonetize(sentences, lexicon, dictionary, lang, mode).select("sent_id", "phonetics", "unknown")
    each = F.transform(F.split(F.translate("phonetics", "{}", ""), "[ |_-]"), P.unstress)
    every = every.withColumn("said", each).withColumn("odd", F.get(F.filter("said", lambda p: ~p.isin(alphabet)), F.lit(0)))
    every = kept(every.select("sent_id", "said", "odd", F.get("unknown", F.lit(0)).alias("word")))
    good = every.where("said is not null and odd is null")
    # phones are rows only where there are frames beside them
    heard = kept(frames.select("sent_id").distinct().join(good.select("sent_id"), "sent_id", "left_semi"))
    code = F.array_position(F.array(*map(F.lit, alphabet)), F.col("phone")) - 1
    targets = good.join(heard, "sent_id", "left_semi").select("sent_id", F.posexplode("said").alias("pos", "phone"))
    targets = kept(targets.select(F.col("sent_id").alias("rec_id"), F.col("pos").cast("long").alias("pos"), code.cast("long").alias("phone_id")))
    own = frames.join(heard, "sent_id", "left_semi").select(F.col("sent_id").alias("rec_id"), "frame_idx", "probs")
    spoken = kept(K.drop_silence(own))
    aligned = kept(K.force_align(spoken, targets))
    path = K.path_rows(aligned, targets).join(spoken.select("rec_id", "t", "frame_idx"), ["rec_id", "t"]).select("rec_id", "frame_idx", "pos", "phone_id")
    pooled = K.pooled_segments(kept(path), spoken, how)
    out = pooled.select(F.col("rec_id").alias("sent_id"), "pos", _no_gaps(F.col("phone_id"), alphabet).alias("phone"), _no_gaps(F.col("predicted"), alphabet).alias("found"), "p_true", "p_predicted", "n_frames", "start", "end")
    unknown = every.where("said is null").select("sent_id", F.concat(F.lit("no pronunciation: "), "word").alias("error"))
    strange = every.where("odd is not null").select("sent_id", F.concat(F.lit("not in the alphabet: "), "odd").alias("error"))
    done = aligned.where("path is not null").select(F.col("rec_id").alias("sent_id"))
    short = good.join(done, "sent_id", "left_anti").select("sent_id", F.lit("too few frames").alias("error"))
    return out, unknown.unionByName(strange).unionByName(short)
