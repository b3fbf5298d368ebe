"""The pipeline's stages one by one on the smallest tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from speechlab.llm import language
from tests.llm.test_exact import brute_contamination, brute_jaccard, brute_runs
from tests.llm.test_models import brute_positions

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept <= ids, name
        docs, ids = corpus_pipeline.stored(out, name), kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == ids
    assert all(r["round_trip"] for r in last)
    assert 50 < len(ids) < 200


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def shares(model, text):
    """The pooled probability of each language, window by window."""
    return brute_positions(model.weights, text.encode()) / len(text.encode())


def mixed(docs, sizes=(3, 40)):
    """Texts of words of all languages by turns: none has much of the probability."""
    rng = random.Random(1)
    own = {}
    for r in docs:
        own.setdefault(r["lang"], []).extend((r["text"] or "").split())
    return [" ".join(rng.choice(own[k]) for _ in range(n) for k in sorted(own)) for n in sizes for _ in range(6)]


def test_brute_run(spark, tmp_path, monkeypatch):
    """The whole run against a run of plain Python, stage by stage.

    The floor of the first stage is raised, so that mixed texts fall under it: the network over whole texts gives words
    of all languages by turns 0.33 to 0.6, over the stage's own floor of 0.3125 (texts of one language have 0.64 and more here).
    """
    monkeypatch.setattr(corpus_pipeline, "LEAST_SHARES", 2.0)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r for r in given.where("lang is not null").orderBy("doc_id").collect() if len(r["text"] or "") < 3000]
    lines = [" ".join(f"{w} word{k}" for k in range(n)) for w, n in (("the", 30), ("and", 10), ("with", 10))]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in some]
    rows += [(800, "\n".join(["one thing", *lines, "the end of this"]), "en"), (801, "\n".join(["another", *lines, "and the start of that"]), "en")]
    rows += [(810, None, "en"), (811, "", "en"), (812, "12 !!", "en"), (813, rows[0][1], "en"), (None, rows[1][1] + " more", "en")]
    rows += [(900 + k, t, None) for k, t in enumerate(mixed(some))]  # no label: they are not learned from
    table = spark.createDataFrame([(i, t, g, "s", None if t is None else len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.select(*given.columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = language.fit(docs.where(~corpus_pipeline.held_out("doc_id", 4, 2)))
    first = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    best = {t: shares(model, t).max() for _, t in first}
    kept = [r for r in first if best[r[1]] >= corpus_pipeline.LEAST_SHARES / len(model.languages)]
    assert 0 < len(first) - len(kept) < 15

    def hashes(pairs):
        return {(r["i"], r["t"]): r["h"] for r in spark.createDataFrame(pairs, "i long, t string").select("i", "t", F.xxhash64("t").alias("h")).collect()}

    order = {k: (k[0] is not None, k[0] or 0, h) for k, h in hashes(kept).items()}
    gone = brute_runs(kept, order)
    second = []
    for i, t in kept:
        cut = gone.get(order[i, t], set())
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        if not cut or left.strip():
            second.append((i, left))
    assert sum(map(len, gone.values())) > 2

    own = hashes(second)
    numbered = [(k, t) for k, (_, t) in enumerate(second)]  # each row by its number, so that ids play no part
    groups = {}
    for k, n, g in brute_jaccard(numbered):
        groups.setdefault(g if n else ("alone", k), []).append(second[k])
    third = [min(g, key=lambda r: (r[0] is None, r[0] or 0, own[r])) for g in groups.values()]
    assert len(third) < len(second)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination([(k, t) for k, (_, t) in enumerate(third)], items) if r[5]}
    want = [i for k, (i, _) in enumerate(third) if k not in bad]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in got)
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str)


def test_no_language_known(spark):
    """Without a model documents with letters stay."""
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [1]


def test_awkward_rows(spark):
    """Each stage on nulls, an empty and a long text, repeated rows and columns with the operators' own names."""
    given = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").limit(40)
    names = ["t", "h", "i", "d", "lines", "lines_deleted", "score", "lang_pred", "cls", "n", "g", "word", "ids", "best"]
    odd = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, "the and of " * 40000, "en"), (4, "a b", None), (4, "a b", None)]
    rows = given.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(i, t, g, None, None) for i, t, g in odd], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = corpus_pipeline.stored(rows.select("*", *[F.lit("x").alias(n) for n in names]), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where("score is null or score <> 'x' or lines <> 'x'").count() == 0
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
