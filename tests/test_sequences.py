"""Edit distance and alignment of token arrays against whole tables, for any alphabet and length."""

import random
import tracemalloc

from pyspark.sql import functions as F

from speechlab.operators import frames as K
from speechlab.operators import joins as J
from speechlab.operators import sequences as S


def table(a, b, cell, top, left):
    rows = [[top(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        rows.append([left(i)])
        for j, y in enumerate(b, 1):
            rows[i].append(cell(rows[i - 1][j - 1], rows[i - 1][j], rows[i][j - 1], x == y and x is not None))
    return rows


def brute_distance(a, b):
    return table(a, b, lambda c, u, s, e: min(c + (not e), u + 1, s + 1), lambda j: j, lambda i: i)[-1][-1]


def brute_alignment(a, b):
    n = table(a, b, lambda c, u, s, e: max(c + e, u, s), lambda j: 0, lambda i: 0)
    i, j, x, y = len(a), len(b), [], []
    while i or j:
        if i and j:
            pair, up, side = n[i - 1][j - 1] + (a[i - 1] == b[j - 1]), n[i - 1][j], n[i][j - 1]
        if i and j and None not in (a[i - 1], b[j - 1]) and pair >= up and pair >= side:
            i, j, p, q = i - 1, j - 1, a[i - 1], b[j - 1]
        elif i and (not j or up >= side):
            i, p, q = i - 1, a[i - 1], "-"
        else:
            j, p, q = j - 1, "-", b[j - 1]
        x.append(p)
        y.append(q)
    return n[-1][-1], x[::-1], y[::-1]


def pairs(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        alphabet = [str(z) for z in range(rng.choice([1, 2, 4, 300]))] + ([None] if k % 5 == 0 else [])
        yield tuple([rng.choice(alphabet) for _ in range(rng.randint(0, rng.choice([3, 12, 80])))] for _ in range(2))


def test_against_whole_tables():
    for a, b in pairs(1, 1500):
        assert S.distance(a, b) == brute_distance(a, b)
        assert S.alignment(a, b) == brute_alignment(a, b)


def test_columns(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs(2, 60))] + [(100, None, ["a"]), (101, ["a"], None), (102, [], []), (103, None, None)]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    out = df.select("k", "a", "b", S.align(F.col("a"), F.col("b")).alias("z"), S.edit_distance(F.col("a"), F.col("b")).alias("d"), K.token_error_rate(F.col("a"), F.col("b")).alias("rate"))
    for r in out.collect():
        if r["a"] is None or r["b"] is None:
            assert r["z"] is None and r["d"] is None and r["rate"] is None
            continue
        assert tuple(r["z"]) == brute_alignment(r["a"], r["b"]) and r["d"] == brute_distance(r["a"], r["b"])
        size = max(len(r["a"]), len(r["b"]))
        assert r["rate"] == (r["d"] / size if size else 0.0)


def test_error_rate_of_large_alphabets(spark):
    """Tokens that no alphabet lists differ from each other."""
    df = spark.createDataFrame([(["ab", "cd"], ["ef", "gh"]), ([f"p{k}" for k in range(300)], [f"p{k}" for k in range(299, -1, -1)])], "a array<string>, b array<string>")
    first, second = (r["rate"] for r in df.select(K.token_error_rate(F.col("a"), F.col("b")).alias("rate")).collect())
    assert first == 1.0 and second == 1.0


def test_recording_check_of_many_phones(spark):
    """Phone ids 256 apart are different phones."""
    size = 400
    hot = lambda k: [1.0 if i == k else 0.0 for i in range(size)]
    frames = spark.createDataFrame([(1, t, hot(p)) for t, p in enumerate([3, 3, 259, 10])], "rec_id long, frame_idx long, probs array<double>")
    expected = spark.createDataFrame([(1, k, p) for k, p in enumerate([3, 3 + 256, 266])], "rec_id long, pos long, phone_id long")
    got = K.recording_check(frames, expected, 0.5, size - 1).first()
    assert abs(got["standard_rate"] - 1 / 3) < 1e-12 and got["count_ratio"] == 1.0


def test_long_transcripts_in_little_memory():
    rng = random.Random(3)
    a = [str(rng.randrange(300)) for _ in range(20000)]
    b = [x for x in a if rng.random() < 0.9] + ["tail"]
    tracemalloc.start()
    n, x, y = S.alignment(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(b) - 1 and [t for t in x if t != "-"] == a and [t for t in y if t != "-"] == b
    assert peak < 20_000_000
    assert 20000 - len(b) <= S.distance(a, b) <= 20000 - len(b) + 2


def test_transfer_in_a_long_transcript(spark):
    words = [f"P{k % 7}_T|AE{k % 3}" for k in range(2000)]
    others = "_".join(w.replace("|", "_") for w in words[5:]).split("_")
    df = spark.createDataFrame([(" ".join(words), 1000, "AE1", others)], "phonetics string, word_idx int, target string, others array<string>")
    got = J.transfer_index(df).first()
    assert got["status"] == "success" and others[got["index"]] == "AE1" and got["index"] == 3 * 995 + 2
