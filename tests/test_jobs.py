"""Whole jobs over recordings, on recordings whose phones are known by construction."""

import numpy as np
from pyspark.sql import functions as F

from speechlab.operators import recordings as R

NAMES = ["AE", "IH", "T", "D", "S", "[SIL]"]
AE, IH, T, D, S, SIL = range(6)


def told(rec, said, each=6, p=0.9):
    """Frames that tell the phones one after another (AE half as long again), with silence before, between words (None) and behind.

    A pair of phones is told as the first, with some likeness to the second.
    """
    rows = []
    for x in [SIL, *said, SIL]:
        main, second = x if isinstance(x, tuple) else (SIL if x is None else x, None)
        probs = [(1 - p) / 5] * 6
        probs[main] = p
        if second is not None:
            probs[main], probs[second] = 0.6, p - 0.6 + (1 - p) / 5
        for _ in range(each * 3 // 2 if main == AE else each):
            rows.append((rec, len(rows), probs))
    return rows


def recordings(spark):
    """Every recording should say S-AE-T T-IH-D-S (two words of one syllable)."""
    said = {
        "right": [S, AE, T, None, T, IH, D, S],
        "vowel": [S, IH, T, None, T, IH, D, S],  # another first vowel
        "ending": [S, AE, T, None, T, IH, (T, D), S],  # T for D in the last cluster
        "nonsense": [D, D, D],
        "quiet": [S, AE, T, None, T, IH, D, S],
    }
    frames = [r for rec, x in said.items() for r in told(rec, x)] + [r for r in told("hasty", [S, AE, T, T, IH, D, S], each=1) if r[1] in (0, 2, 3, 5)]
    goal = [(0, S, 0), (1, AE, 0), (2, T, 0), (3, T, 1), (4, IH, 1), (5, D, 1), (6, S, 1)]
    recs = [*said, "hasty", "empty"]
    expected = [(rec, pos, phone, word, 0, 0) for rec in recs for pos, phone, word in goal]
    info = [(rec, True, 10.0 if rec == "quiet" else 60.0, 0.0 if rec == "empty" else 1.0, 2, 120.0) for rec in recs]
    return (
        spark.createDataFrame(info, "rec_id string, sound boolean, level double, seconds double, n_syllables long, pitch double"),
        spark.createDataFrame(frames, "rec_id string, frame_idx long, probs array<double>"),
        spark.createDataFrame(expected, "rec_id string, pos long, phone_id long, word long, syllable long, chunk long"),
    )


def test_analysis(spark):
    info, frames, expected = recordings(spark)
    levels = frames.select("rec_id", "frame_idx", F.when(F.get("probs", F.lit(AE)) > 0.5, 80.0).otherwise(50.0).alias("level"))
    got = R.analyse(info, frames, expected, NAMES, [AE, IH], levels, usual=0.75)
    checks = {r["rec_id"]: r for r in got.checks.collect()}
    status = {k: r["status"] for k, r in checks.items()}
    assert status == {"right": "success", "vowel": "success", "ending": "success", "nonsense": "no match", "quiet": "too quiet", "empty": "empty", "hasty": "alignment failed"}
    assert checks["right"]["error_rate"] < checks["ending"]["error_rate"] and checks["quiet"]["error_rate"] is None
    assert abs(checks["right"]["cost"] + 45 * 0.9) < 1e-9

    segments = {(r["rec_id"], r["pos"]): r for r in got.segments.collect()}
    assert {k for k, _ in segments} == {"right", "vowel", "ending"} and len(segments) == 21
    assert [segments["right", k]["found"] for k in range(7)] == ["S", "AE", "T", "T", "IH", "D", "S"]
    assert segments["vowel", 1]["found"] == "IH" and segments["ending", 5]["found"] == "T"
    assert abs(segments["right", 0]["start"] - 0.12) < 1e-9 and abs(segments["right", 0]["end"] - 0.24) < 1e-9 and segments["right", 1]["n_frames"] == 9

    rows = {}
    for r in got.aspects.orderBy("rec_id", "word", "syllable", "place").collect():
        rows.setdefault(r["rec_id"], []).append((r["word"], r["position"], r["phones"], r["detection"], r["word_bit"], r["sentence_bit"]))
    first = [(0, "start", "S", "S", 1, 1), (0, "middle", "AE", "AE", 1, 1), (0, "end", "T", "T", 1, 1)]
    second = [(1, "start", "T", "T", 1, 0), (1, "middle", "IH", "IH", 1, 0), (1, "end", "D_S", "D_S", 1, 0)]
    assert rows["right"] == first + second
    assert [r[3] for r in rows["vowel"]] == ["S", "IH", "T", "T", "IH", "D_S"]
    assert [r[3] for r in rows["ending"]] == ["S", "AE", "T", "T", "IH", "T_S"]
    mended = R.analyse(info, frames, expected, NAMES, [AE, IH], levels, accepted={"D": ["T"]}, usual=0.75).aspects
    assert mended.where("rec_id = 'ending' and word = 1 and position = 'end'").first()["detection"] == "D_S"


def test_analysis_without_recordings(spark):
    info, frames, expected = recordings(spark)
    got = R.analyse(info.limit(0), frames, expected, NAMES, [AE, IH])
    assert got.checks.count() == got.segments.count() == got.aspects.count() == 0


def test_frame_classifier(spark):
    """Vectors around a point for each phone are told apart; a phone without training frames has probability 0."""
    rng = np.random.default_rng(1)
    points = rng.normal(0, 5, (3, 12))
    rows = [(k, ["a", "b", "c"][k % 3], [float(x) for x in points[k % 3] + rng.normal(0, 0.3, 12)]) for k in range(240)]
    frames = spark.createDataFrame(rows, "id long, phone string, vector array<double>")
    model = R.fit_frame_classifier(frames, ["a", "b", "c", "z"], k=5, variance=0.95, cap=50)
    assert model.train.count() == 150
    new = spark.createDataFrame([(1, k, [float(x) for x in points[k % 3] + rng.normal(0, 0.3, 12)]) for k in range(30)], "rec_id long, frame_idx long, vector array<double>")
    got = R.phone_probabilities(new, model).collect()
    assert len(got) == 30
    for r in got:
        assert len(r["probs"]) == 4 and r["probs"][3] == 0.0 and abs(sum(r["probs"]) - 1) < 1e-9
        assert int(np.argmax(r["probs"])) == r["frame_idx"] % 3


def test_corpus(spark):
    lexicon = spark.createDataFrame([("sat", 0, "S_AE1_T"), ("tids", 0, "T_IH1_D_S"), ("zoo", 0, "Z_IH1")], "word string, alt_idx int, phones string")
    dictionary = spark.createDataFrame([("sat", "sat", 1, 1)], "syllables string, word string, n_syls long, n_syls_phones long")
    texts = spark.createDataFrame([(1, "Sat tids."), (2, "Sat xyzzy"), (3, "Zoo sat"), (4, "Sat, sat")], "sent_id long, text string")
    frames = [r for k, x in ((1, [S, AE, T, T, IH, D, S]), (3, [S, AE])) for r in told(k, x)] + told(4, [S], each=2)
    got, errors = R.build_corpus(texts, spark.createDataFrame(frames, "sent_id long, frame_idx long, probs array<double>"), lexicon, dictionary, NAMES)
    rows = got.orderBy("sent_id", "pos").collect()
    assert [(r["sent_id"], r["phone"], r["found"], r["n_frames"]) for r in rows] == [(1, p, p, 9 if p == "AE" else 6) for p in ["S", "AE", "T", "T", "IH", "D", "S"]]
    assert {(r["sent_id"], r["error"]) for r in errors.collect()} == {(2, "no pronunciation: xyzzy"), (3, "not in the alphabet: Z"), (4, "too few frames")}
