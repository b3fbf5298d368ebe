"""Forced alignment of recordings that no task takes whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlab.operators import alignment as A
from speechlab.operators import frames as K


def recordings(spark, sizes, n_phones=9, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    frames, targets = [], []
    for rec, (t, n) in enumerate(sizes):
        p = rng.integers(0, 3, (t, n_phones)) / 4 if ties else rng.random((t, n_phones))
        frames += [(rec, k, [float(x) for x in p[k]]) for k in range(t)]
        targets += [(rec, k, int(rng.integers(0, n_phones))) for k in range(n)]
    return spark.createDataFrame(frames, "rec_id long, t long, probs array<double>"), spark.createDataFrame(targets, "rec_id long, pos long, phone_id long")


@pytest.mark.parametrize("ties", [False, True])
def test_blocks_give_the_same_paths(spark, ties):
    frames, targets = recordings(spark, [(40, 7), (5, 5), (3, 9), (200, 30), (64, 1), (129, 60), (1, 1)], ties=ties)
    want = {r["rec_id"]: (r["cost"], r["path"]) for r in K.force_align(frames, targets).collect()}
    for block, cells in ((1, 0), (16, 0), (64, 0), (1000, 0), (32, 500)):
        got = {r["rec_id"]: (r["cost"], r["path"]) for r in K.force_align(frames.repartition(5), targets, cells, block).collect()}
        assert got == want
    assert want[2] == (None, None) and len(want[3][1]) == 200


def test_long_recording(spark):
    """20,000 frames of 300 phones that are told clearly."""
    n, each = 300, 66
    frames = spark.range(n * each).select(F.lit("r").alias("rec_id"), F.col("id").alias("t"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when(k == F.floor(F.col("id") / each) % 12, 0.9).otherwise(0.01)).alias("probs"))
    targets = spark.range(n).select(F.lit("r").alias("rec_id"), F.col("id").alias("pos"), (F.col("id") % 12).alias("phone_id"))
    got = K.force_align(frames, targets, whole_cells=1000).first()
    assert got["path"] == [k // each for k in range(n * each)] and abs(got["cost"] + 0.9 * n * each) < 1e-6


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("weights", ["distance", "uniform"])
def test_neighbours_in_groups(spark, metric, weights):
    """A training side in groups gives what a training side that every task reads gives."""
    rng = np.random.default_rng(4)
    rows = [(k, f"c{k % 5}", [float(x) for x in rng.integers(-3, 4, 6)]) for k in range(400)] + [(400, "c0", None), (401, "c1", [float("nan")] * 6)]
    train = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(3)
    test = spark.createDataFrame([(k, [float(x) for x in rng.integers(-3, 4, 6)]) for k in range(90)] + [(90, None)], "id long, v array<double>")
    plain = {(r["id"], r["label"]): r["p"] for r in A.knn_probabilities(train, test, 7, metric, weights).collect()}
    dealt = {(r["id"], r["label"]): r["p"] for r in A.knn_probabilities(train, test, 7, metric, weights, most_training=0, group_rows=40).collect()}
    assert plain.keys() == dealt.keys() and len({i for i, _ in plain}) == 90
    assert all(abs(plain[x] - dealt[x]) < 1e-9 for x in plain)
    assert A.knn_probabilities(train.limit(0), test, 7, metric, weights).count() == 0
