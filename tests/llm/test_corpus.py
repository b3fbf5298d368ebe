"""Importance resampling, the prefix trie and token counts against brute-force versions on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlab.llm import importance, prefix_trie, token_counts
from speechlab.llm.queries import tokenizer_file

DOC = "doc_id long, text string, lang string, place long, short string, n_words long, row long, k string, c long"


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 7, "s", 8, 9, "k", 1) for i, t in rows], DOC)


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["é", "Über", "42", "日本語", "İx", "don't", "we'll", "x,y", "(a)", "--", "'s", "<|endoftext|>", "<|", "é", "ﬁ", " ", "\x1c", "½", "٣", "Σς", "word</w>"]
    out = [(i, rng.choice([" ", "\n", "  ", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    copies = [(n + i, out[3][1]) for i in range(20)]
    return [*out, *copies, (500, None), (501, ""), (502, " \n\t"), (None, "a null id of few words"), (None, None), out[5], out[5], (503, "x" * 70_000), (504, "ab " * 30_000), (505, "<|endoftext|><|startoftext|>a<|endoftext|>B")]


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_importance(rows, target, percent, longest, buckets, least, seed):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[a : a + n]).encode()) % buckets for n in range(1, longest + 1) for a in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (total_s + buckets) / ((s[k] + 1) * (total_t + buckets)))) for k in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("seed, longest, percent", [(1, 1, 10), (2, 3, 50), (3, 2, 100)])
def test_importance(spark, seed, longest, percent):
    rows = texts(seed)
    target = [t for _, t in texts(seed + 10, 10)][:12] + [None]
    given = spark.createDataFrame([(str(k), t, 1) for k, t in enumerate(target)], "item_id string, text string, weight long")
    got = importance.resample(documents(spark, rows).repartition(3), given, percent, longest, 500, 20, 99)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_importance(rows, target, percent, longest, 500, 20, 99)


def test_importance_empty(spark):
    docs = documents(spark, texts(1))
    assert importance.resample(docs.limit(0), docs, 10, 1, 100, 20, 1).count() == 0
    got = importance.resample(docs, docs.limit(0), 10, 1, 100, 20, 1)
    assert got.count() == docs.count() and got.where("rank is not null").count() > 0


def test_prefix_crc_of_long_runs():
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 123, 100_000, dtype=np.uint8))
    crc = importance.shift(np.array([5, 0xFFFFFFFF, 0], dtype=np.uint32), np.array([0, 100_000, 3]))
    assert crc[0] == 5 and crc[2] == 0
    # over zero bytes the library's register moves alike
    assert int(crc[1]) == zlib.crc32(b"\0" * 100_000) ^ 0xFFFFFFFF
    document, found = importance.Prefixes([data, b"", b"a b"]).features(2)
    assert [int(x) for x in found[document == 0]] == [zlib.crc32(data)]
    assert sorted(map(int, found[document == 2])) == sorted(map(zlib.crc32, (b"a", b"b", b"a b")))


def brute_trie(rows, head, onto):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            lanes = [int.from_bytes(digest[a : a + 8], "big", signed=True) for a in (0, 8)]
            own[c].append(((turn is not None, turn or 0, *lanes), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    convs = {c: own.get(onto(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    saved, leaves = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted(
        ((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in nodes.items()), key=repr
    )


def conversations(seed, n=60, longest=12):
    rng = random.Random(seed)
    said = ["hi", "", None, "how are you", "é", "ok", "x" * 500]
    rows, made = [], []
    for c in range(n):
        if made and rng.random() < 0.6:
            base = rng.choice(made)
            turns = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "bot", None]), rng.choice(said)) for _ in range(rng.randint(0, 4))]
        else:
            turns = [(rng.choice(["user", "bot"]), rng.choice(said)) for _ in range(rng.randint(1, longest))]
        turns = turns or [("user", "hi")]
        made.append(turns)
        if rng.random() < 0.85:  # some numbers are absent
            rows += [(c, None if k == 0 and c % 7 == 0 else k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [r for r in rows if r[0] in (3, 4)]  # repeated rows
    rows += [(None, 1, "user", "nobody")] + [(900 + k, j, "user", "copy") for k in range(30) for j in range(5)]
    return rows


@pytest.mark.parametrize("seed, block, chunk", [(1, 4, 1 << 20), (2, 1, 40), (3, 3, 40), (4, 50, 40)])
def test_trie(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "conv_id long, turn long, role string, text string, depth long, n long").repartition(3)
    turns = prefix_trie.numbered_turns(df)
    c = F.col("conv_id")
    sizes, rebuilt = prefix_trie.grafted(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5, 8)
    got = prefix_trie.trie(sizes, rebuilt, block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows, lambda x: zlib.crc32(str(x).encode()) % 9, lambda x: x - x % 5)


def test_trie_of_long_conversations(spark):
    rows = [(c, k, "user", f"t{k}" if k < 600 + c % 3 else f"t{k} {c}") for c in range(6) for k in range(700 + 50 * c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes, rebuilt = prefix_trie.grafted(prefix_trie.numbered_turns(df), F.lit(0), F.col("conv_id"), 0)
    assert sorted(map(tuple, prefix_trie.trie(sizes, rebuilt).collect()), key=repr) == brute_trie(rows, lambda x: 0, lambda x: x)


def test_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    sizes, rebuilt = prefix_trie.grafted(prefix_trie.numbered_turns(df), F.lit(3), F.col("conv_id"), 3)
    assert prefix_trie.trie(sizes, rebuilt).count() == 0


@pytest.mark.parametrize("name, head", [("word_bpe_49k.json", 1 << 17), ("word_bpe_49k.json", 0), ("byte_bpe_50k.json", 5)])
def test_token_counts(spark, name, head):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(name))
    rows = texts(7)
    got = token_counts.count_tokens(documents(spark, rows).repartition(3), tokenizer_file(name), 50, head_size=head)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 50))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(documents(spark, rows).limit(0), tokenizer_file(name)).count() == 0


def test_token_counts_of_memory_that_runs_over(spark, monkeypatch):
    """Every character beyond ASCII's letters beside others, with little memory."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, "".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1F9FF)])) for _ in range(200))) for i in range(60)]
    path = tokenizer_file("word_bpe_49k.json")
    monkeypatch.setattr(token_counts, "HELD", 20)
    cutter = token_counts.PreTokens(path)
    for _, t in rows:
        words, found = cutter.words(t)
        assert found + sum(cutter.pieces(p) for w in words for p in cutter.pre_tokens(w)) == len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
