"""Alignment and line assignment against plain Python on small inputs."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from speechlab import catalogue
from speechlab.operators import alignment as A


def best(a, b):
    """Length of the longest common subsequence, from all subsequences of ``a``."""

    def inside(s, t):
        rest = iter(t)
        return all(x in rest for x in s)

    return max(n for n in range(len(a) + 1) for s in itertools.combinations(a, n) if inside(s, b))


def test_align_is_longest(spark):
    words = ["", "a", "ab", "ba", "abcab", "bcacb", "cccab", "abcdef", "fbdace"]
    pairs = [(list(x), list(y)) for x in words for y in words]
    df = spark.createDataFrame(pairs, "x array<string>, y array<string>").withColumn("z", A.align(F.col("x"), F.col("y")))
    for r in df.collect():
        z = r["z"]
        assert z["n_match"] == best(r["x"], r["y"])
        assert len(z["a"]) == len(z["b"])
        assert [t for t in z["a"] if t != "-"] == r["x"] and [t for t in z["b"] if t != "-"] == r["y"]
        assert sum(p == q for p, q in zip(z["a"], z["b"])) == z["n_match"]


def test_align_null(spark):
    df = spark.createDataFrame([(None, ["a"])], "x array<string>, y array<string>")
    assert df.select(A.align(F.col("x"), F.col("y")).alias("z")).first()["z"] is None


def test_words_beyond_the_last_line(spark):
    words = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c"), (1, 2, "de"), (2, 0, "x")], "doc long, pos long, word string")
    lines = spark.createDataFrame([(1, 0, "abc")], "doc long, line long, letters string")
    got = {(r["doc"], r["pos"]): r["line"] for r in A.assign_lines(words, lines, ["doc"], "pos", "line").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): None, (2, 0): None}


def test_exact_neighbours_alone_count(spark):
    train = spark.createDataFrame([(1, 7, [0.0, 0.0]), (2, 8, [1.0, 0.0]), (3, 8, [0.0, 2.0])], "id long, label long, v array<double>")
    test = spark.createDataFrame([(10, [0.0, 0.0]), (11, [0.5, 0.0])], "id long, v array<double>")
    got = {(r["id"], r["label"]): round(r["p"], 6) for r in A.knn_probabilities(train, test, 2).collect()}
    assert got == {(10, 7): 1.0, (11, 7): 0.5, (11, 8): 0.5}


def test_knn_whole_vectors(spark, tmp_path):
    """The registered query against brute force: 64 components, most of them past the eighth, and a label over its cap."""
    rng = random.Random(2)
    data = [(i, [0.0] * 8 + [rng.choice((-0.5, 0.25, 1.0)) for _ in range(56)], 0 if i < 510 else 1 + i % 3) for i in range(540)]
    data += [(600 + i, data[i][1], 2) for i in range(0, 540, 60)]
    odd = [(900, None, 1), (901, [float("nan")] * 64, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(data + odd, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    dealt = {}
    for i, v, label in data:
        dealt.setdefault(label, []).append((hashlib.md5(str(i).encode()).hexdigest(), i, v))
    train = [(i, v, label) for label, own in dealt.items() for _, i, v in sorted(own)[:500]]
    assert len(train) < len(data)
    want = {}
    for i, v, _ in data:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, u)) ** 0.5, j, label) for j, u, label in train)[:10]
        exact = any(d == 0 for d, _, _ in near)
        w = {}
        for d, _, label in near:
            w[label] = w.get(label, 0) + ((d == 0) if exact else 1 / d)
        want |= {(i, label): x / sum(w.values()) for label, x in w.items() if x}
    got = {(r["id"], r["label"]): r["p"] for r in catalogue.queries()["k2_knn_probabilities_whole"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
