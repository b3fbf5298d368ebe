"""Queries on whole jobs: operators in a row from frames and texts to reports. They have no SQL: trained models and forced alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechlab.catalogue_pronunciation import _dictionary, _sentences
from speechlab.operators import recordings as J
from speechlab.plans.registry import add
from speechlab.plans.scratch import kept


def _long(col: str):
    return F.col(col).cast("long").alias(col)


def _r(col: str):
    return F.round(F.col(col), 6).alias(col)


_NAMES = ["AE", "B", "EH", "K", "IH", "S", "OW", "T", "UH", "[SIL]"]


@add("job_recording_analysis", None, "fx_frames", "fx_targets")
def _(frames, targets):
    frames = kept(frames.select("rec_id", "frame_idx", "probs"))
    goal = targets.select("rec_id", _long("pos"), _long("phone_id"), F.expr("pos div 2").alias("word"), F.lit(0).cast("long").alias("syllable"), F.lit(0).cast("long").alias("chunk"))
    sizes = frames.groupBy("rec_id").agg((F.count("*") * 0.02).alias("seconds")).join(goal.groupBy("rec_id").agg(F.count("*").alias("n_syllables")), "rec_id")
    info = sizes.select("rec_id", F.lit(True).alias("sound"), F.when(F.col("rec_id") % 5 == 4, 10.0).otherwise(60.0).alias("level"), "seconds", "n_syllables", F.lit(120.0).alias("pitch"))
    levels = frames.select("rec_id", "frame_idx", (100 * F.array_max("probs")).alias("level"))
    # any error rate passes: these frames are no speech
    out = J.analyse(info, frames, goal, _NAMES, [0, 2, 4, 6, 8], levels, {"B": ["K"]}, least=0.25, usual=1.01, single=1.01)
    return out.aspects.join(out.checks.select("rec_id", _r("error_rate"), F.round("cost", 4).alias("cost")), "rec_id")


@add("job_recording_checks", None, "fx_frames", "fx_targets")
def _(frames, targets):
    """As above with the usual bounds: most of these recordings are no match."""
    frames = kept(frames.select("rec_id", "frame_idx", "probs"))
    goal = targets.select("rec_id", _long("pos"), _long("phone_id"), F.expr("pos div 2").alias("word"), F.lit(0).cast("long").alias("syllable"), F.lit(0).cast("long").alias("chunk"))
    info = frames.groupBy("rec_id").agg((F.count("*") * 0.02).alias("seconds")).select("rec_id", F.lit(True).alias("sound"), F.lit(60.0).alias("level"), "seconds", F.lit(5).cast("long").alias("n_syllables"), F.lit(120.0).alias("pitch"))
    return J.analyse(info, frames, goal, _NAMES, [0, 2, 4, 6, 8], None, least=0.25).checks.select("rec_id", "status", _r("error_rate"))


@add("job_frame_classifier", None, "embeddings")
def _(embeddings):
    """Reduction and neighbours over whole vectors: frames are told from at most 500 training frames of each label."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("phone"), F.col("embedding").cast("array<double>").alias("vector"))
    model = J.fit_frame_classifier(rows, [str(k) for k in range(10)])
    out = J.phone_probabilities(rows.withColumn("vector", F.reverse("vector")), model, ("id",))
    return out.select("id", F.transform("probs", lambda p: F.round(p, 6)).alias("probs"))


@add("job_corpus", None, "fx_tokens", "fx_lexicon", "fx_syl", "fx_frames")
def _(tokens, lexicon, syl, frames):
    """Texts to phonetics to segments, over the sentences of all documents: a recording says the first sentence of the document of its number."""
    ok = lexicon.sparkSession.createDataFrame([("ok", 0, "OW1_K")], "word string, alt_idx int, phones string")
    lexicon = kept(lexicon.where("word <> 'ok'").unionByName(ok))
    phones = sorted(r["phone"] for r in lexicon.select(F.explode(F.split(F.regexp_replace("phones", "[012]", ""), "_")).alias("phone")).distinct().collect())  # an alphabet
    alphabet = (phones + [f"_{k}" for k in range(27)])[:27] + ["[SIL]"]
    texts = kept(_sentences(tokens, lexicon))
    first = texts.groupBy(F.expr("sent_id div 1000000").alias("rec_id")).agg(F.min("sent_id").alias("sent_id"))
    probs = F.concat(F.flatten(F.array_repeat(F.slice("probs", 1, 9), 3)), F.slice("probs", 10, 1))
    own = frames.join(first, "rec_id").select("sent_id", "frame_idx", probs.alias("probs"))
    out, errors = J.build_corpus(texts, own, lexicon, kept(_dictionary(syl, lexicon)), alphabet)
    told = out.select("sent_id", "pos", "phone", "found", F.round("p_true", 5).alias("p_true"), "n_frames", F.lit(None).cast("string").alias("error"))
    return told.unionByName(errors, allowMissingColumns=True)
