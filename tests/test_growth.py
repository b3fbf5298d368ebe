"""Steps whose work has to grow no faster than the input."""

from pyspark.sql import functions as F

from speechlab.operators import alignment as A
from speechlab.operators import windows as W


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_only_grow(spark):
    """A frame up to the end of a group is read again for every row, so the work is the square of a document's words."""
    n = 3000
    words = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.lit("ab").alias("word"))
    lines = spark.range(n // 8).select(F.lit(1).alias("doc"), F.col("id").alias("line"), F.lit("a" * 16).alias("letters"))
    got = A.assign_lines(words, lines, ["doc"], "pos", "line")
    assert "unboundedfollowing" not in plan(got)
    assert got.where("line <> pos div 8").count() == 0 and got.count() == n
    spans = spark.range(100).select(F.lit(1).alias("f"), F.col("id").alias("start"), (F.col("id") + F.when(F.col("id") % 10 == 3, 5).otherwise(1)).alias("end"))
    left = W.resolve_overlaps(spans, ["f"], ["start"])
    assert "unboundedfollowing" not in plan(left)
    assert sorted(r["start"] for r in left.collect()) == [k for k in range(100) if k % 10 != 3]


def test_words_without_phones_are_no_hot_key(spark, monkeypatch):
    """Most words may lack phones, so share one key; it stays in its partitions, and the words are worked out once."""
    from speechlab.operators import hot
    from speechlab.operators import selection as E

    monkeypatch.setattr(hot.join_frequent, "__defaults__", ("n", 10, 100))
    words = spark.range(400).select((F.col("id") % 20).alias("file_id"), F.floor(F.col("id") / 20).alias("word_idx"), F.when(F.col("id") % 9 == 0, "T_AE1").alias("phones"))
    got = E.format_selection(words.where("word_idx = 3").select("file_id", "word_idx"), words, "T")
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in tree and "Range" not in tree.split("Join")[-1]
    rows = {r["file_id"]: r for r in got.collect()}
    assert len(rows) == 20
    for f, r in rows.items():
        said = ["T_AE1" if (f + 20 * k) % 9 == 0 else "AH0" for k in range(20)]
        assert r["phonetics"] == " ".join(said) and r["syllable"] == (0 if said[3] == "T_AE1" else None)


def test_symbols_are_looked_for_in_words_that_hold_them(spark):
    """A text is not worked out again for each rule that tests it: every rule stands once in the plan."""
    from speechlab.functions import numbers as N

    rows = spark.createDataFrame([("$1.50 at %7, 1.00€ of 7,500\n2.5 1,2,3",), ("no number, $ % €",), (None,)], "t string")
    got = rows.select(N.expand_symbols(F.col("t")).alias("o"))
    assert plan(got).count("regexp_replace(") <= 30
    assert [r["o"] for r in got.collect()] == ["1 dollar and 50 cents at 7 percent, 1 euro of 7500\n2 point 5 123", "no number, $ % €", None]


def test_only_recordings_with_enough_frames_are_aligned(spark, monkeypatch):
    """A recording without a frame for each phone has no path, and no task of Python is started for it."""
    from speechlab.operators import frames as K

    seen, whole = [], K._whole
    monkeypatch.setattr(K, "_whole", lambda own, goals: seen.extend(r["rec_id"] for r in goals.select("rec_id").distinct().collect()) or whole(own, goals))
    targets = spark.range(40).select(F.col("id").alias("rec_id"), F.explode(F.expr("array(0L, 1L)")).alias("pos")).withColumn("phone_id", F.col("pos"))
    frames = spark.createDataFrame([(3, 0, [0.9, 0.1]), (3, 1, [0.2, 0.8]), (4, 0, [0.5, 0.5])], "rec_id long, t long, probs array<double>")
    got = {r["rec_id"]: r["path"] for r in K.force_align(frames, targets).collect()}
    assert seen == [3] and len(got) == 40 and got.pop(3) == [0, 1] and not any(got.values())


def test_tokens_of_sentences_are_worked_out_once(spark, monkeypatch):
    """Marks, case, numbers and syllables are told of distinct tokens, not of all sentences."""
    from speechlab.operators import phonetize as Z

    seen, normalized = [], Z.normalized
    monkeypatch.setattr(Z, "normalized", lambda rows, key="sent_id": seen.append(rows.count()) or normalized(rows, key))
    lexicon = spark.createDataFrame([("sat", 0, "S_AE1_T"), ("two", 0, "T_UW1")], "word string, alt_idx int, phones string")
    dictionary = spark.createDataFrame([("sat", "sat", 1, 1)], "syllables string, word string, n_syls long, n_syls_phones long")
    texts = spark.range(50).select(F.col("id").alias("sent_id"), F.when(F.col("id") % 2 == 0, "Sat , 2 sat!").otherwise("Sat xyzzy, 2.").alias("text"))
    good, bad = Z.phonetize_safe(texts, lexicon, dictionary)
    assert seen == [6]  # tokens with their marks: two that hold Sat, two 2, one sat and one xyzzy
    rows = {(r["phonetics"], r["segmented_text"], tuple(r["methods"])) for r in good.collect()}
    assert len(rows) == 1 and next(iter(rows))[0] == "S_AE1_T T_UW1 S_AE1_T" and good.count() == 25
    assert {r["word"] for r in bad.collect()} == {"xyzzy"} and bad.count() == 25


def test_texts_are_cut_to_words_once(spark):
    """Tables of words that a query reads beside each other stand on one stored table of tokens."""
    from speechlab import catalogue

    for name in ("j11_stem_semi", "x18_phonetize_errors"):
        read = catalogue.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and not any("documents" in f for f in read)


def test_only_unknown_words_are_grouped_for_errors(spark):
    """The first unknown word of a text is taken from its unknown words, not from all its words."""
    from speechlab.operators import lexicon as X

    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 2, "y"), (2, 0, "a")], "doc_id long, pos int, word string")
    ok, bad = X.first_phones(tokens, spark.createDataFrame([("a", 0, "AH0")], "word string, alt_idx int, phones string"))
    assert "CASE WHEN" not in plan(bad)
    assert [tuple(r) for r in bad.collect()] == [(1, 1, "x")] and [tuple(r) for r in ok.collect()] == [(2, "AH0")]


def test_stress_is_told_in_one_shuffle(spark, monkeypatch):
    """Words meet in as many tasks as there are rows for, and bits come back to their syllables without a join."""
    from speechlab import catalogue
    from speechlab.plans import scratch

    rows = [(r, w // 2, w, s, (r * 31 + w * 17 + s * 53) % 101) for r in range(30) for w in range(r % 7 + 1) for s in range((r + w) % 3 + 1)]
    got = W.stress_table(spark.createDataFrame([*rows, (None, 0, 0, 0, 5), (99, 0, None, 0, 5)], "rec_id long, chunk long, word long, syllable long, score long"))
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in tree and tree.count("hashpartitioning") == 1
    want = set()
    for r in range(30):
        own = [x for x in rows if x[0] == r]
        score = {(w, s): 100 if len(own) == 1 else v for _, _, w, s, v in own}
        top = {w: max(v for (u, _), v in score.items() if u == w) for _, _, w, _, _ in own}
        for _, c, w, s, _ in own:
            best = min(u for (x, u), v in score.items() if x == w and v == top[w])
            chunk = sorted((u for u in top if u // 2 == c), key=lambda u: (-top[u], u))
            want.add((r, w, s, int(s == best), int(len(chunk) == 1 or (chunk.index(w) < -(-len(chunk) // 3) and top[w] >= 60))))
    assert {tuple(x) for x in got.select("rec_id", "word", "syllable", "word_bit", "sentence_bit").collect()} == want and len(want) == len(rows)
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    assert scratch.tasks_for(spark.range(2001)) == 5 and scratch.tasks_for(spark.range(9)) == 4
    tree = catalogue.queries()["w14_stress_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert tree.count("hashpartitioning") == 1 and "l_orderkey#" in tree.split("hashpartitioning")[1][:20]


def test_keys_of_a_phrase_are_worked_out_once(spark):
    """A row's entries are sorted and named once, whatever looks at the cleaned phrase later."""
    from speechlab.operators import programs as R

    rows = spark.createDataFrame([(1, {" Flag": "a ", "flag ": "b", "Mark": "c", "ID": "7"}), (2, {"B ": None, "a": " x"}), (3, None), (4, {})], "n long, phrase map<string,string>")
    out = R.clean_keys(rows, {"flag": "mark"}, dropped=("id",)).where(F.coalesce(F.size("phrase"), F.lit(0)) < 3)
    assert plan(out).count("map_entries(") == 1 and out.columns == ["n", "phrase"]
    assert {r["n"]: r["phrase"] for r in out.collect()} == {1: {"mark": "a"}, 2: {"a": "x", "b": None}, 3: None, 4: {}}


def test_subtitles_are_in_few_files(spark):
    """Files grow with the tasks, not with the recordings; a recording's lines are its subtitles in order."""
    from speechlab.plans.scratch import folder
    from speechlab.sources import files as S

    said = [(f"r\t{k}\n", k % 2, f"w{i}" if i else "a\tb\nc", float(i), i + 0.5) for k in range(60) for i in (2, 0, 1)] + [(None, 1, "x", 0.0, 1.0)]
    path = folder(spark)
    S.write_srt(spark.createDataFrame(said, "rec string, part long, text string, start double, end double"), path, ["rec", "part"])
    assert len(spark.read.text(path).inputFiles()) <= 4
    got = S.read_srt(spark, path, "rec string, part long")
    assert got.select("rec", "part").distinct().count() == 61
    lines = [r["line"] for r in got.where(F.col("rec") == "r\t7\n").where("part = 1").collect()]
    cue = lambda n, a: [str(n), f"00:00:0{n - 1},000 --> 00:00:0{n - 1},500", *a, ""]
    assert lines == cue(1, ["a\tb", "c"]) + cue(2, ["w1"]) + cue(3, ["w2"])
    assert [r["line"] for r in got.where("rec is null").collect()] == ["1", "00:00:00,000 --> 00:00:01,000", "x", ""]


def test_a_batch_of_a_feed_is_read_by_all_tasks(spark, monkeypatch):
    """Batches of a feed stay three and hold as many files as a shuffle has tasks, instead of one."""
    from speechlab import catalogue_files as CF
    from speechlab.plans.scratch import folder
    from speechlab.streaming import live

    paths = []
    monkeypatch.setattr(CF, "folder", lambda s: paths.append(folder(s)) or paths[-1])
    rows = spark.range(1000).select(F.lit("x").alias("status"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = CF._stream(rows, rows.limit(1).select(F.lit("late").alias("status"), CF._far()), lambda df: live.stream_gate_counts(df, "1 day", "400 days"))
    assert [(r["status"], r["n"]) for r in got.where("status = 'x'").collect()] == [("x", 1000)]
    assert len(spark.read.parquet(paths[0]).inputFiles()) == 3 * 4 + 2


def test_pairs_of_neighbours_are_cut_with_the_words(spark):
    """The next word is known where a text is cut, so documents are not shuffled and sorted for it."""
    from speechlab import catalogue
    from speechlab.plans.fixtures import table

    sf = "/root/testdata/sf0.001"
    want = table(spark, sf, "fx_tokens").selectExpr("doc_id", "lang", "pos", "word", "lead(word) over (partition by doc_id order by pos) as next")
    got = table(spark, sf, "fx_neighbours")
    assert got.columns == want.columns and got.count() == want.count() and not got.exceptAll(want).count()
    physical = lambda name: catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    tree = physical("e13_ed_pairs")
    assert "Exchange" not in tree and tree.count("regexp_replace(trim(") == 1
    assert "Window" not in physical("x12_compounds") and "Window" not in physical("e6_contrast_pairs")


def test_stems_are_told_of_distinct_words(spark):
    """A word's stems are looked up once, however often it stands in the texts."""
    from speechlab.operators import joins as J

    words = spark.range(4000).select(F.expr("array('cats', 'rating', 'dog', 'cating')[id % 4]").alias("word"))
    got = J.stem_semi(words, spark.createDataFrame([("cat",), ("rati",), ("cati",)], "word string"))
    tree = plan(got)
    assert tree.index("Generate explode") < tree.rindex("Aggregate [word") and "Range" not in tree[: tree.rindex("Aggregate [word")].split("Generate")[0]
    assert {r["word"] for r in got.collect()} == {"cats", "rating", "cating"} and tree.count("Aggregate [word") == 2


def test_words_of_files_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """Both shuffles of a text's words grow with them, and a word has one row when it gets there."""
    import re

    from speechlab import catalogue
    from speechlab.plans import scratch
    from speechlab.plans.fixtures import table

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(scratch, "TASK_ROWS", 5000)
    n = scratch.tasks_for(table(spark, sf, "fx_tokens"))
    tree = catalogue.queries()["j9_first_match_phonetics"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and len(set(re.findall(rf"hashpartitioning\((\w+)#\d+L?, {n}\)", tree))) == 2
