"""Rates of nothing, unfinished tables, many tiers, digits of other scripts, and phrases of a live feed."""

import random

import pytest
from pyspark.sql import functions as F

from speechlab.functions import text as T
from speechlab.operators import metrics as G
from speechlab.operators import ordered
from speechlab.operators import windows as W
from speechlab.plans.scratch import folder
from speechlab.sources import files as S


def test_rates_of_nothing(spark):
    frames = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 3.0])], "label string, probs array<double>")
    assert sorted(map(tuple, G.posterior_matrix(frames, "label").collect())) == [("a", 0, 0.0), ("a", 1, 0.0), ("b", 0, 0.25), ("b", 1, 0.75)]
    rows = spark.createDataFrame([("x", 5, 0), ("y", 5, 2), ("y", 1, 2)], "k string, p long, n long")
    assert sorted(map(tuple, G.weighted_confidence(rows, ["k"], "p", "n").collect())) == [("x", 0, 0, None), ("y", 12, 4, 3.0)]
    none = G.threshold_sweep(spark.createDataFrame([(0.5,), (0.7,)], "s double"), "s", F.lit(False)).orderBy("threshold").collect()
    assert [(r["tpr"], r["fpr"]) for r in none] == [(None, 0.5), (None, 1.0)]
    df = spark.createDataFrame([([1, 0], [], [2]), ([0, 1], [], [2])], "bins array<int>, found array<int>, counts array<int>")
    got = G.sentence_stress_eval(df).first()
    assert got["n"] == 2 and got["failure_rate"] == 1.0 and got["found_rate"] is None and got["hit_rate"] is None and got["base_rate"] == 0.5
    empty = spark.createDataFrame([], "k long, pos long, phone string, found string")
    assert G.match_rates(empty, ["k"]).first()["phone_rate"] is None


def test_sweep_over_many_scores(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random() < 0.3) for _ in range(3000)]
    got = G.threshold_sweep(spark.createDataFrame(rows, "s double, p boolean").repartition(7), "s", F.col("p")).collect()
    n_p = sum(p for _, p in rows)
    by_score = sorted(rows)
    seen, want = 0, {}
    for k, (s, p) in enumerate(by_score):
        seen += p
        want[s] = (seen / n_p, (k + 1 - seen) / (len(rows) - n_p))
    assert {r["threshold"]: (r["tpr"], r["fpr"]) for r in got} == want


@pytest.mark.parametrize("long_group", [10**6, 3])
def test_control_pairs(spark, monkeypatch, long_group):
    monkeypatch.setattr(ordered.scan, "__defaults__", (long_group,))
    rows = [(r, f, r % 2, [0.2 + r / 100, 0.5]) for r in range(40) for f in range(3)]
    frames = spark.createDataFrame(rows, "rec_id long, frame_idx long, label long, probs array<double>")
    got = {r["rec_id"]: r["mean"] for r in G.mismatched_truth_stats(frames, F.col("label"), 9).collect()}
    assert len(got) == 40
    for r in range(40):
        label = (r - 1) % 40 % 2
        assert abs(got[r] - (0.5 if label else 0.2 + r / 100)) < 1e-9


def test_unfinished_tables_are_written_again(spark):
    path = folder(spark)
    df = spark.range(10)
    df.write.parquet(f"{path}/run-0-half")
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run-0-half/_SUCCESS")
    half.getFileSystem(spark._jsc.hadoopConfiguration()).delete(half, False)
    assert S.materialize(df.limit(0).union(df), path, "ignore").count() == 10
    assert S.materialize(df.limit(0), path, "ignore").count() == 10
    with pytest.raises(FileExistsError):
        S.materialize(df, path)
    assert S.materialize(spark.range(3), path, "overwrite").count() == 3
    assert S.materialize(df, path, "ignore").count() == 3
    other = folder(spark)
    first, second = S.materialize(df, other, "overwrite"), S.materialize(spark.range(4), other, "overwrite")  # neither sees the other's rows
    assert first.count() == 10 and second.count() == 4


def test_all_tiers_of_a_file(spark, tmp_path):
    one = 'item [{k}]:\n class = "IntervalTier"\n name = "t{k}"\n intervals: size = 1\n intervals [1]:\n xmin = 0 \n xmax = {k} \n text = "m{k}" \n'
    (tmp_path / "a.TextGrid").write_text("head\nitem []:\n" + "".join(one.format(k=k) for k in range(1, 301)))
    got = S.read_tiers(spark, str(tmp_path))
    assert got.count() == 300 and got.where("tier = 't300' and mark = 'm300' and `end` = 300").count() == 1


def test_digits_of_all_scripts(spark):
    df = spark.createDataFrame([("x²y٣",), ("a1b",), ("½ⅷ",), ("一二①",)], "w string")
    assert [r["o"] for r in df.select(T.clean_letters(F.col("w")).alias("o")).collect()] == ["xy", "ab", "½ⅷ", "一二"]


def test_live_phrases_are_those_of_the_batch(spark):
    """The same words as files of a feed, with a late one within the delay: the phrases of ``sessionize``."""
    from speechlab.streaming import live

    rng = random.Random(5)
    rows, at = [], 0.0
    for k in range(120):
        at += rng.choice([0.0, 0.3, 0.6, 3.0])
        long = rng.choice([0.2, 0.5, 2.5])
        rows.append(("f" if k % 3 else "g", k, f"w{k}", round(at, 3), round(at + long, 3)))
        at += long
    batch = spark.createDataFrame(rows, "file_id string, word_id long, word string, start double, end double")
    source = folder(spark)
    late = list(rows)
    late[10], late[11] = late[11], late[10]
    for a in range(0, len(late), 20):
        spark.createDataFrame(late[a : a + 20], batch.schema).coalesce(1).write.mode("append").parquet(source)
    end = [("f", 10**6, "end", at + 9e5, at + 9e5), ("g", 10**6 + 1, "end", at + 9e5, at + 9e5)]
    spark.createDataFrame(end, batch.schema).coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_micros(F.round(F.col("start") * 1000000).cast("long")))
    out = live.stream_sessions(feed, 1.0, "60 seconds")
    query = out.writeStream.format("memory").queryName("phrases").outputMode("append").option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = [tuple(r) for r in spark.table("phrases").where("text <> 'end'").select("file_id", "text", F.round("start", 3), F.round("end", 3), "n_words").collect()]
    want = W.sessionize(batch, 1.0, ["file_id"], ["start", "word_id"]).select("file_id", "text", F.round("start", 3), F.round("end", 3), "n_words").collect()
    assert sorted(got) == sorted(map(tuple, want))
