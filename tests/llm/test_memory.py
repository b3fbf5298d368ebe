"""What the pipeline's Python workers hold: no second kind of worker, small temporary arrays, few remembered units."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.core import rdd

from speechlab.llm import jaccard, pieces
from speechlab.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def test_no_python_rdd_beside_the_workers_of_dataframes(spark, monkeypatch):
    made = []
    init = rdd.PipelinedRDD.__init__
    monkeypatch.setattr(rdd.PipelinedRDD, "__init__", lambda self, *a, **b: (made.append(a), init(self, *a, **b))[1])
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2, 3, 4], "text": [text, text, "another text of some words here", None]}))
    assert {r["doc_id"] for r in jaccard.keep_one(docs).collect()} == {1, 3, 4}
    assert all(r["round_trip"] for r in pieces.encoded_documents(docs, MODEL).collect())
    assert not made


def test_sketches_are_summed_in_steps(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    own = [np.arange(jaccard.CELLS, dtype=np.int64) * k for k in range(7)]
    rows = pa.table({"part": pa.array([zlib.compress(x.tobytes(), 1) for x in own], pa.binary())})
    assert (jaccard._summed(spark.createDataFrame(rows).repartition(5)) == sum(own)).all()
    assert not jaccard._summed(spark.createDataFrame(rows).limit(0)).any()


def test_shingles_of_a_batch_take_little_memory():
    text = " ".join(f"word{k % 977}" for k in range(40_000))
    column = pa.array([text[k : k + 4_000] for k in range(0, len(text), 4_000)] * 8)
    sets = [s for _, _, data, bounds in jaccard.text_chunks(column, 1 << 16) for s in jaccard.shingle_sets(data, bounds)]
    tracemalloc.start()
    found = []
    size = getattr(jaccard, "CHUNK_BYTES", 1 << 20)
    for _, _, data, bounds in jaccard.text_chunks(column, size):
        found += [jaccard.class_of(s) for s in jaccard.shingle_sets(data, bounds)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [jaccard.class_of(s) for s in sets]
    assert peak < 20e6


def test_hashes_of_texts_over_a_block_are_those_of_their_words():
    words = [f"w{k * 7919}" for k in range(60_000)]
    whole = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    assert len(whole) > jaccard.CHUNK_BYTES
    found = jaccard.hashed_words(whole, np.array([0, len(whole)])).hash
    for k in (0, 30_000, 45_000, 59_999):
        one = np.frombuffer(words[k].encode(), dtype=np.uint8)
        assert jaccard.hashed_words(one, np.array([0, len(one)])).hash[0] == found[k]


def test_few_units_are_remembered():
    model = pieces.load(MODEL)
    encode = pieces._encoder(model, {}, "units of this test")
    memory = pieces._remembered("units of this test")
    for a in range(0, 150_000, 1_000):
        encode(" ".join(str(k) for k in range(a, a + 1_000)))
    assert 20_000 < len(memory["young"]) + len(memory["old"]) <= 101_000
