"""SentencePiece encoding against the library, the Viterbi fold against all segmentations, and round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from speechlab.llm import pieces
from speechlab.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "  a  b\nc ", "é ﬁ ① \t x▁y", "\n\n", "日本語のテキスト", "a" * 300, "!!!???...", "🙂🙂 ok", "The quick brown fox"]
    for _ in range(40):
        out.append(" ".join("".join(rng.choice("aeinrstlé.,!- T") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 30))))
    return out


@pytest.mark.parametrize("head", [0, 50, 1000])
def test_library(spark, head):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    encoded = pieces.encode(docs, MODEL, ["doc_id"], head=head)
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() for r in encoded.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in rows:
        assert got[i] == library.encode(t or ""), t
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(encoded, MODEL, ["doc_id"]).collect()}
    for i, t in rows:
        assert back[i] == (t or "").replace("▁", " ")


def test_digest(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = pieces.encoded_documents(docs, MODEL).collect()
    assert {r["doc_id"] for r in got if not r["round_trip"]} == {4}  # its text holds the blank mark itself
    assert pieces.encoded_documents(docs.limit(0), MODEL).count() == 0


def test_viterbi(spark):
    """Every segmentation of short words, under random scores."""
    rng = random.Random(3)
    alphabet = "abc"
    known = {w: i + 300 for i, w in enumerate(sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(14)} | {"a"}))}
    scores = {w: -round(rng.random() * 9, 3) for w in known}
    model = pieces.Pieces(known, scores, 3, [], False)
    words = sorted({"".join(rng.choice(alphabet + "é") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    floor = min(scores.values()) - pieces.UNKNOWN

    def ways(w):
        if not w:
            yield 0.0, []
        for k in range(1, len(w) + 1):
            p = w[:k]
            if p in scores or k == 1:
                own = [known[p]] if p in scores else [3 + b for b in p.encode()]
                for s, rest in ways(w[k:]):
                    yield s + scores.get(p, floor), own + rest

    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w in words:
        every = sorted(ways(w))
        best = [ids for s, ids in every if s > every[-1][0] - 1e-9]
        assert got[w] in best, w
        assert pieces.fold_unit(w, model) == got[w], w
