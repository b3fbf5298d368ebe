"""Joins on hot keys, order over whole tables, and walks through groups that no task takes whole."""

import random

import pytest
from pyspark.sql import functions as F

from speechlab.operators import ordered
from speechlab.operators import windows as W
from speechlab.operators.hot import join_frequent


def test_join_frequent_spreads_hot_words(spark):
    """A word of a third of all tokens: the same rows, and no task with over three times the median."""
    rng = random.Random(1)
    rows = [(k, "the" if k % 3 == 0 else f"w{rng.randrange(2000)}") for k in range(30000)]
    df = spark.createDataFrame(rows, "k long, word string").repartition(8)
    table = df.groupBy("word").agg(F.count("*").alias("n"), F.upper("word").alias("up"))
    got = join_frequent(df, table, ["word"], hot=500)
    assert got.columns == ["word", "k", "up"]
    assert sorted(map(tuple, got.collect())) == sorted((w, k, w.upper()) for k, w in rows)
    sizes = sorted(r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    # frequent keys beyond the bound are shuffled with the others
    assert join_frequent(df, table, ["word"], hot=1, most=3).count() == 30000
    assert join_frequent(df.limit(0), table.limit(0), ["word"]).count() == 0


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([1, 2, None]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, k long")
    got = ordered.positions(df, ["x", "k"], ["g"]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in ("a", None, "b"):
        want = sorted((r for r in rows if r[0] == g), key=key)
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])
        assert [(r["g"], r["x"], r["k"]) for r in own] == want and [r["position"] for r in own] == list(range(1, len(want) + 1))
    whole = ordered.positions(df, ["x", "k"]).orderBy("position").collect()
    assert [(r["g"], r["x"], r["k"]) for r in whole] == sorted(rows, key=key)


def brute_runs(rows):
    """(file, k, label) -> run, segment, whether the first, the last and one of several rows of its run."""
    out = []
    for f in sorted({r[0] for r in rows}, key=str):
        own = sorted((r for r in rows if r[0] == f), key=lambda r: r[1])
        run, segment, marks = 0, 0, []
        for i, r in enumerate(own):
            new = i == 0 or r[2] is None or own[i - 1][2] is None or r[2] != own[i - 1][2]
            run, segment = run + new, 0 if new else segment + 1
            marks.append((run, segment))
        for i, r in enumerate(own):
            last = i + 1 == len(own) or marks[i + 1][0] != marks[i][0]
            out.append((*r, *marks[i], marks[i][1] == 0, last))
    return out


@pytest.mark.parametrize("long_group", [10**6, 10])
def test_runs(spark, monkeypatch, long_group):
    """Nulls are runs of their own; a file in many partitions has the runs of a file in one."""
    monkeypatch.setattr(ordered.scan, "__defaults__", (long_group,))
    rng = random.Random(3)
    rows = [("long", k, rng.choice(["x", "x", "x", "y", None])) for k in range(700)] + [("same", k, "z") for k in range(300)]
    rows += [(None, k, rng.choice(["x", None])) for k in range(30)] + [("one", 5, None)]
    df = spark.createDataFrame(rows, "file string, k long, label string").repartition(5)
    want = brute_runs(rows)
    text = lambda x: sorted(x, key=str)
    assert text(map(tuple, W.run_id(df, "label", ["file"], ["k"]).select("file", "k", "label", "run").collect())) == text(w[:4] for w in want)
    assert text(map(tuple, W.segment_numbers(df, "label", ["file"], ["k"]).select("file", "k", "label", "run", "segment").collect())) == text(w[:5] for w in want)
    assert text(map(tuple, W.dedupe_runs(df, "label", ["file"], ["k"]).select("file", "k", "label").collect())) == text(w[:3] for w in want if w[5])
    assert text(map(tuple, W.run_edges(df, "label", ["file"], ["k"]).select("file", "k", "label").collect())) == text(w[:3] for w in want if w[5] or w[6])
    assert text(map(tuple, W.run_blocks(df, "label", ["file"], ["k"]).select("file", "k", "label").collect())) == text(w[:3] for w in want if not (w[5] and w[6]))
    assert W.run_id(df.limit(0), "label", ["file"], ["k"]).count() == 0
    a, b, c, d, e = (r["run"] for r in W.run_id(spark.createDataFrame([(k, v) for k, v in enumerate(["a", None, "b", None, None])], "k long, label string").withColumn("f", F.lit(1)), "label", ["f"], ["k"]).orderBy("k").collect())
    assert (a, b, c, d, e) == (1, 2, 3, 4, 5)


@pytest.mark.parametrize("long_group", [10**6, 10])
def test_sessions(spark, monkeypatch, long_group):
    monkeypatch.setattr(ordered.scan, "__defaults__", (long_group,))
    rng = random.Random(4)
    rows, at = [], 0.0
    for k in range(400):
        at += rng.choice([0.1, 0.2, 5.0])
        rows.append(("f", k, f"w{k}", at, at + 0.1))
        at += 0.1
    df = spark.createDataFrame(rows, "file string, k long, word string, start double, end double").repartition(4)
    got = W.sessionize(df, 1.0, ["file"], ["start", "k"]).orderBy("start").collect()
    want = [[rows[0]]]
    for a, b in zip(rows, rows[1:]):
        want.append([b]) if b[3] - a[4] > 1.0 else want[-1].append(b)
    assert [(r["text"], r["start"], r["end"], r["n_words"]) for r in got] == [(" ".join(x[2] for x in w), w[0][3], w[-1][4], len(w)) for w in want]


def test_one_long_file_uses_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered.scan, "__defaults__", (10,))
    df = spark.range(0, 40000, 1, 4).select(F.lit("f").alias("file"), F.col("id").alias("k"), (F.col("id") / 7).cast("long").alias("label"))
    out = W.run_id(df, "label", ["file"], ["k"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40000 and len(sizes) >= 3
    assert out.where("run <> label + 1").count() == 0
