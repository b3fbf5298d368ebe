"""Bounds that limit what is sent, other percentages, and extra columns with the names of helper columns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechlab.llm import decontaminate, jaccard, knn, line_dedup, token_files
from speechlab.llm._common import shared_dir
from speechlab.llm.queries import tokenizer_file
from tests.llm.test_exact import brute_top


def clusters(n_clusters, size, dim=8, spread=400.0, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (n_clusters, dim))
    centre *= spread / np.linalg.norm(centre, axis=1, keepdims=True)
    return [(c * size + k, [float(x) for x in (centre[c] + rng.normal(0, 0.3, dim)).round(3)]) for c in range(n_clusters) for k in range(size)]


def test_knn_sends_only_what_bounds_need(spark, monkeypatch):
    """Queries in 3 of 12 far-off clusters: blocks of the other clusters are not sent, and others go to one group each."""
    rows = clusters(12, 300)
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    wanted = [i for i, _ in rows if i < 900 and i % 20 == 0]
    queries = data.where((F.col("id") < 900) & (F.col("id") % 20 == 0))
    seen = []
    plain = knn.sent

    def counted(blocks, pairs, dealt, parts):
        out = plain(blocks, pairs, dealt, parts)
        seen.append((blocks.count(), out.count(), out.select("ids").distinct().count(), len({c for c, _ in dealt.items()})))
        return out

    monkeypatch.setattr(knn, "sent", counted)
    got = knn.top_k(data, queries, 5, pivots=40, task_queries=1)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, set(wanted), 5)
    blocks, copies, distinct, cells = seen[0]
    assert distinct < blocks  # clusters without a query stay where they are
    assert copies < blocks * cells / 3  # and no block goes to every group of queries


def test_knn_families():
    pivots = np.array([[0.0], [100.0], [1.0], [101.0], [2.0]])
    dealt = knn.families({0: 2, 1: 5, 2: 2, 3: 1, 4: 30}, pivots, 10)
    assert dealt[0] == dealt[2] == (0, 1) and dealt[1][0] == dealt[3][0] and dealt[4][1] == 3


def brute_components(rows, percent):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            head[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [60, 70, 90])
@pytest.mark.parametrize("often", [0, None])
def test_jaccard_other_percentages(spark, percent, often):
    """Linked sets of very different sizes meet whatever counts as frequent."""
    rng = random.Random(percent)
    rows, k = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 160))]
        rows.append((k, " ".join(base)))
        more = int(len(base) * 100 / percent * rng.choice([0.98, 0.995, 1.0, 1.01]))
        rows.append((k + 1, " ".join(base + [f"w{rng.randrange(10**6)}" for _ in range(more - len(base))])))
        k += 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(docs, percent=percent, often=often).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_components(rows, percent)


def test_jaccard_sizes_two_classes_apart(spark):
    """Sets of 109 and 155 shingles with a similarity of 0.703."""
    words = [f"w{k}" for k in range(159)]
    docs = spark.createDataFrame([(1, " ".join(words[:113])), (2, " ".join(words))], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.near_duplicates(docs, percent=70, often=0).collect()} == {1}


def test_clashing_columns(spark):
    names = ["__t", "__bad", "__bad_t", "__id", "__head", "__lines", "__kept", "__placed", "placed", "id", "t", "d", "runs"]
    rows = [(k, f"some words of document number {k} in a row of ten words", "en", "s", 1) for k in range(6)]
    rows += [(6, None, None, None, None), (7, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    items = spark.createDataFrame([("a", "some words of document number 3 in a row of ten words")], "item_id string, text string")

    def kept(df):
        out = df.select("doc_id", *names).collect()
        assert all(r[n] == f"mine {r['doc_id']}" for r in out for n in names)
        return sorted(r["doc_id"] for r in out)

    assert kept(decontaminate.drop_contaminated(docs, items)) == [0, 1, 2, 4, 5, 6, 7]
    assert kept(jaccard.keep_one(docs)) == [0, 1, 2, 3, 4, 5, 6]
    assert kept(line_dedup.drop_repeated_runs(docs)) == list(range(8))
    assert kept(corpus_pipeline.identify_language(spark, docs, "")) == [0, 1, 2, 3, 4, 5, 7]


def test_token_files_of_one_id(spark):
    """Rows of one id are dealt to several shards and keep their order."""
    rows = [(None, f"word {k}") for k in range(200)] + [(5, f"other {k % 3}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = shared_dir(spark)
    manifest = token_files.write(docs, tokenizer_file("word_bpe_49k.json"), folder, 2, shards=6)
    assert manifest.where("docs > 0").count() > 3
    back = token_files.read(manifest, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None] * 200 + [5] * 100
    starts = [r["start"] for r in back]
    assert starts == [sum(r["n_tokens"] for r in back[:k]) for k in range(300)]
