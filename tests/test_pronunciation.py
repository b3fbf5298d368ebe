"""Numbers, syllables, sentences and alignments against golden values and plain restatements on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from speechlab.functions import numbers as N
from speechlab.functions import phonetics as P
from speechlab.functions import text as T
from speechlab.operators import classifiers as C
from speechlab.operators import frames as K
from speechlab.operators import joins as J
from speechlab.operators import metrics as G
from speechlab.operators import phonetize as Z
from speechlab.operators import selection as E
from speechlab.operators import syllables as Y
from speechlab.operators.alignment import knn_probabilities


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    golden = {
        "22": "twenty-two", "122": "one hundred twenty-two", "0": "zero", "2000": "two thousand", "2005": "two thousand five", "1984": "nineteen eighty-four",
        "1905": "nineteen oh five", "1900": "nineteen hundred", "3000": "three thousand", "1000": "one thousand", "1234567": "one million, two hundred thirty-four thousand, five hundred sixty-seven",
        "21st": "twenty-first", "12th": "twelfth", "101st": "one hundred and first", "20th": "twentieth", "$3000": "three thousand dollars", "(7)": "(seven)",
        "124001": "one hundred twenty-four thousand one", "1000000": "one million", "1,001st": "one thousand and first", "0002005": "two thousand five", "000": "zero",
        "1" + "0" * 30: "one nonillion", "5" * 19: "five quintillion, five hundred fifty-five quadrillion, five hundred fifty-five trillion, five hundred fifty-five billion, five hundred fifty-five million, five hundred fifty-five thousand, five hundred fifty-five",
        "9" * 36: ", ".join(f"nine hundred ninety-nine{g}" for g in reversed(N.GROUPS)), "9" * 37: "9" * 37, "a" + "7" * 40 + "b3": "a" + "7" * 40 + "bthree",
    }
    rows = spark.createDataFrame([(k,) for k in golden] * 2 + [("no digits",)], "token string")
    got = {r["token"]: r["words"] for r in N.number_table(rows).collect()}
    assert got == golden
    assert rows.select(N.number_words(F.lit(None).cast("long")).alias("w")).first()["w"] is None


def test_symbols(spark):
    golden = {
        "$1.00": "1 dollar", "2.50€": "2 euros and 50 cents", "$0.01": "1 cent", "$0": "zero dollars", "$1.2.3": "1.2.3 dollars".replace("1.2", "1 point 2"), "1,234,567%": "1234567 percent",
        "%5": "5 percent", "3.14": "3 point 14", "$1 and $11": "1 dollar and 11 dollars", "100% $": "100 percent $", "11 dollars": "11 dollars",
        "£5 and 1₹ or ₩0.00": "5 pounds and 1 rupee or zero wons", "2.5₫": "2 dongs and 5 cents", "₦.01": "1 cent", "P7": "7 pulas", "A £ sign, 7 Q": "A £ sign, 7 Q", "€1.00": "1 euro", "0€": "zero euros",
    }
    assert column(spark, list(golden), "string", N.expand_symbols) == list(golden.values())


def test_marks(spark):
    words = column(spark, ['"Hello, world!" ** (x)'], "string", lambda c: T.edge_maps(F.split(c, " ")))[0]
    assert words["before"] == {0: '"', 2: "**"} and words["after"] == {0: ",", 1: '!"', 2: "**"}
    assert column(spark, [["UCLA", "a", "I"]], "array<string>", T.spell_acronyms) == [["u-c-l-a", "a", "i"]]
    assert column(spark, ["c-A-b"], "string", lambda c: T.acronym_compound(F.array(c, F.lit("I")), F.array(F.lit(0), F.lit(1)))) == [["{c A b}", "I"]]
    assert column(spark, ["re|cord"], "string", lambda c: T.restore_case(F.array(c), F.array(F.lit("ReCORD")))) == [["Re|CORD"]]
    lines = ["CORP-C01-P1,000012 7", "no hyphen, here", "plain"]
    assert column(spark, lines, "string", T.rewrite_utterance_line) == ["CORP-C01.wav,P1-012 7".replace("-012", "-012"), "no hyphen.wav, here", "plain"]


def sonority(symbol, mode):
    if mode == "letters":
        for value, letters in ((5, Y.VOWELS), (3, "lmnrw"), (2, "zvsfh")):
            if symbol in letters:
                return value
        return 0
    if symbol[-1] in "012":
        return 5
    return {"HH": 0}.get(symbol, next((v for c, v in (("approximant", 3), ("nasal", 3), ("fricative", 2), ("affricate", 1)) if symbol in P.CATEGORIES[c]), 0))


def plain_syllables(symbols, mode):
    """The rule symbol by symbol: a syllable ends before a trough, and after a plateau that does not fall from above."""
    if mode != "letters":
        symbols = [x for s in symbols for x in ((s, "*W") if sonority(s, mode) == 5 else (s,))]
    son = [3 if s == "*W" else sonority(s, mode) for s in symbols]
    if son.count(5) == 1:
        parts = [symbols]
    else:
        parts, now = [], symbols[:1]
        for i in range(1, len(symbols)):
            if i == len(symbols) - 1:
                now = [*now, symbols[i]]
                parts.append(now)
            elif son[i] < son[i - 1] and son[i] < son[i + 1]:
                parts.append(now)
                now = [symbols[i]]
            elif son[i] == son[i + 1] and son[i] <= son[i - 1]:
                parts.append([*now, symbols[i]])
                now = []
            else:
                now = [*now, symbols[i]]
    out, front = [], []
    for p in parts:
        if any(s != "*W" and sonority(s, mode) == 5 for s in p):
            out.append([*front, *p] if not out else p)
        elif out:
            out[-1] = [*out[-1], *p]
        else:
            front = [*front, *p]
    return [[s for s in p if s != "*W"] for p in out]


@pytest.mark.parametrize("mode", ["letters", "CMU"])
def test_syllables(spark, mode):
    rng = random.Random(4)
    if mode == "letters":
        words = ["justification", "a", "b", "rhythm", "strengths", "idea"] + ["".join(rng.choice("aeioulmnrzsftkdbg") for _ in range(rng.randint(1, 12))) for _ in range(300)]
        split, joint = list, ""
    else:
        alphabet = ["AH0", "IY1", "ER0", "L", "N", "W", "S", "HH", "CH", "T", "D", "K"]
        words = ["K_AA1_F_IY0"] + ["_".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(300)]
        split, joint = (lambda w: w.split("_")), "_"
    got = {r["word"]: r["syllables"] for r in Y.syllabify(spark.createDataFrame([(w,) for w in words], "word string"), mode=mode).collect()}
    for w in words:
        assert got[w] == [joint.join(p) for p in plain_syllables(split(w), mode)], w
    if mode == "letters":
        assert got["justification"] == ["jus", "ti", "fi", "ca", "tion"] and got["b"] == []
    else:
        assert got["K_AA1_F_IY0"] == ["K_AA1", "F_IY0"]


def test_ending_rules(spark):
    words = ["smiled", "angled", "raises", "smiles", "prism", "rhythms", "fired", "table", "isms", "logarithm", "ed"]
    got = {r["word"]: r["syllables"] for r in Y.ending_rules(spark.createDataFrame([(w,) for w in words], "word string"), "en").collect()}
    assert got["smiled"] == "smiled" and got["smiles"] == "smiles" and got["prism"] == "pri|sm" and got["isms"].endswith("i|sms") and got["logarithm"].endswith("i|thm")
    assert all(v.replace("|", "") == w for w, v in got.items())
    french = {r["word"]: r["syllables"] for r in Y.ending_rules(spark.createDataFrame([("tables",), ("dépendance",)], "word string"), "fr").collect()}
    assert french["dépendance"].endswith("e") and french["dépendance"].replace("|", "") == "dépendance" and french["tables"].replace("|", "") == "tables"


def plain_transfer(word, phones):
    x, y = [sonority(c, "letters") for c in word], [sonority(p, "CMU") for p in phones]
    best = {}
    for i in range(len(x)):
        for j in range(len(y)):
            ways = [best[k][0] for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in best]
            back = [k for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in best]
            least = min(ways, default=0)
            best[i, j] = (least + abs(x[i] - y[j]), back[ways.index(least)] if ways else None)
    at, cell = {}, (len(x) - 1, len(y) - 1)
    while cell:
        at[cell[1]] = cell[0]
        cell = best[cell][1]
    starts, n = [], 0
    for s in plain_syllables(phones, "CMU"):
        starts.append(at[n] if n else 0)
        n += len(s)
    return [word[a:b] for a, b in zip(starts, [*starts[1:], len(word)])]


def test_transfer(spark):
    rng = random.Random(9)
    alphabet = ["AH0", "IY1", "L", "N", "S", "T", "K", "M"]
    rows = [("".join(rng.choice("aeiolnstkm") for _ in range(rng.randint(1, 9))), "_".join([rng.choice(alphabet) for _ in range(rng.randint(1, 7))] + ["AH0"])) for _ in range(80)]
    got = {(r["word"], r["phones"]): r["syllables"] for r in Y.transfer_syllables(spark.createDataFrame(rows, "word string, phones string"), "CMU").collect()}
    for w, p in rows:
        assert got[w, p] == plain_transfer(w, p.split("_")), (w, p)


LEXICON = [
    ("i", 0, "AY1"), ("paid", 0, "P_EY1_D"), ("a", 0, "AH0"), ("a", 1, "EY1"), ("u", 0, "Y_UW1"), ("c", 0, "S_IY1"), ("l", 0, "EH1_L"), ("three", 0, "TH_R_IY1"),
    ("thousand", 0, "TH_AW1_Z_AH0_N_D"), ("dollars", 0, "D_AA1_L_ER0_Z"), ("bill", 0, "B_IH1_L"), ("well", 0, "W_EH1_L"), ("known", 0, "N_OW1_N"), ("record", 0, "R_AH0_K_AO1_R_D"),
    ("record", 1, "R_EH1_K_ER0_D"), ("fire", 0, "F_AY1_ER0"), ("fire", 1, "F_AY1_R"), ("visiting", 0, "V_IH1_Z_AH0_T_IH0_NG"),
]
SYLLABLES = [("thou|sand", "thousand", 2, 2), ("dol|lars", "dollars", 2, 2), ("re|cord", "record", 2, 2), ("fire", "fire", 1, 2), ("vis|it|ing", "visiting", 3, 3)]


def test_phonetize(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, alt_idx int, phones string")
    dictionary = spark.createDataFrame(SYLLABLES, "syllables string, word string, n_syls long, n_syls_phones long")
    texts = [(1, "I  paid a $3000 bill , UCLA !"), (2, "Well-known *record*..."), (3, "Fire"), (4, "unheard-of bill"), (5, ""), (6, None), (7, "Visiting UCLA")]
    sentences = spark.createDataFrame(texts, "sent_id long, text string")
    good, bad = Z.phonetize_safe(sentences, lexicon, dictionary)
    got = {r["sent_id"]: r for r in good.collect()}
    assert set(got) == {1, 2, 3, 7}
    assert [tuple(r) for r in bad.collect()] == [(4, "unheard-of")]
    one = got[1]
    assert one["text"] == "I paid a $3000 bill, {UCLA}!"
    assert one["phonetics"] == "AY1 P_EY1_D AH0 {TH_R_IY1 TH_AW1|Z_AH0_N_D D_AA1|L_ER0_Z} B_IH1_L {Y_UW1 S_IY1 EH1_L EY1}"
    assert one["segmented_text"] == "I paid a {three thou|sand dol|lars} bill {U C L A}"
    assert list(one["n_alternatives"]) == [1, 1, 2, 1, 1, 1, 1, 1] and one["methods"][0] == "acronym" and one["methods"][-1] == "acronym"
    assert list(one["n_syl_mismatches"]) == [] and list(one["n_stress_inconsistencies"]) == []
    assert got[2]["phonetics"] == "W_EH1_L-N_OW1_N R_AH0|K_AO1_R_D" and got[2]["segmented_text"] == "Well-known re|cord" and got[2]["text"] == "Well-known *record*..."
    assert list(got[2]["phonetics_alt"][1]) == ["R_AH0|K_AO1_R_D", "R_EH1|K_ER0_D"]
    assert got[3]["phonetics"] == "F_AY1_R" and list(got[3]["n_alternatives"]) == [2]  # the first alternative has two syllables
    guide = Z.phonetize(sentences.where("sent_id = 3"), lexicon, dictionary, readable={"F": "f", "AY": "eye", "R": "r"}).first()["guide"]
    assert guide == "feyer"
    report = Z.mismatch_report(Z.phonetize(sentences.where("sent_id = 3"), lexicon.where("not (word = 'fire' and alt_idx = 1)"), dictionary)).collect()
    assert [tuple(r) for r in report] == [(3, 1, 0, "Fire", "F_AY1|ER0")]


def plain_alignment(p, goal):
    """The cheapest of all monotone paths; of equals the one that goes on last (seen from the end: goes on first)."""
    best = None

    def walk(t, j, cost, path):
        nonlocal best
        cost, path = cost - p[t][goal[j]], [*path, j]
        if t == len(p) - 1:
            if j == len(goal) - 1:
                key = (round(cost, 9), [-x for x in reversed(path)])
                best = min(best, (key, path), key=lambda k: (k[0][0], [-x for x in k[0][1]])) if best else (key, path)
            return
        walk(t + 1, j, cost, path)
        if j + 1 < len(goal):
            walk(t + 1, j + 1, cost, path)

    walk(0, 0, 0.0, [])
    return None if best is None else (best[0][0], best[1])


def test_force_align(spark):
    rng = random.Random(2)
    frames, targets, want = [], [], {}
    for rec in range(25):
        t, n = rng.randint(1, 8), rng.randint(1, 4)
        p = [[round(rng.random(), 3) for _ in range(3)] for _ in range(t)]
        goal = [rng.randrange(3) for _ in range(n)]
        frames += [(rec, i, v) for i, v in enumerate(p)]
        targets += [(rec, i, g) for i, g in enumerate(goal)]
        want[rec] = plain_alignment(p, goal) if t >= n else None
    targets.append((99, 0, 1))
    got = K.force_align(spark.createDataFrame(frames, "rec_id long, t long, probs array<double>"), spark.createDataFrame(targets, "rec_id long, pos long, phone_id long"))
    got = {r["rec_id"]: (r["cost"], r["path"]) for r in got.collect()}
    assert got.pop(99) == (None, None) and set(got) == set(want)
    for rec, w in want.items():
        if w is None:
            assert got[rec] == (None, None)
        else:
            assert abs(got[rec][0] - w[0]) < 1e-9
            path = got[rec][1]
            assert path[0] == 0 and all(b - a in (0, 1) for a, b in zip(path, path[1:])) and len(path) == len(w[1]) and path[-1] == w[1][-1]


def test_targets_and_runs(spark):
    alphabet = ["HH", "AW", "L", "AH", "V", "IY"]
    rows = spark.createDataFrame([("HH", 0, 0), ("QQ", 0, 0), ("HH", 2, 0), ("HH", 0, 1), ("V", 0, 0), ("IY0", 1, 1)], "t string, w int, s int")
    got = [r["e"] for r in rows.select(P.target_error(F.lit("HH_AW1 L_AH1|V_L_IY0"), F.col("t"), F.col("w"), F.col("s"), alphabet, F.lit(0)).alias("e")).collect()]
    assert got == [None, "target phone QQ is not a phoneme", "word_idx >= n of words", "syl_idx >= n of syllables", "target not in syllable", None]
    assert column(spark, [["a", "a", "b"], []], "array<string>", P.rle) == [[("a", 2), ("b", 1)], []]


def test_sweep_over_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("s"), (F.col("id") % 3 == 0).alias("p"))
    data = sorted((r["s"], r["p"]) for r in rows.collect())
    n, m, tp, fp, want = sum(p for _, p in data), sum(not p for _, p in data), 0, 0, {}
    for s, p in data:
        tp, fp = tp + p, fp + (not p)
        want[s] = (tp / n, fp / m)
    got = {r["threshold"]: (r["tpr"], r["fpr"]) for r in G.threshold_sweep(rows, "s", F.col("p")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) + abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_knn_metrics(spark):
    train = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 8, [0.0, 3.0]), (3, 8, [10.0, 10.0])], "id long, label long, v array<double>")
    test = spark.createDataFrame([(10, [5.0, 0.1])], "id long, v array<double>")
    cosine = {r["label"]: r["p"] for r in knn_probabilities(train, test, 2, "cosine").collect()}
    assert cosine[7] > 0.99
    assert {r["label"]: r["p"] for r in knn_probabilities(train, test, 3, "euclidean", "uniform").collect()} == {7: 1 / 3, 8: 2 / 3}
    with pytest.raises(ValueError):
        knn_probabilities(train, test, 2, "other")


def test_classifiers(spark):
    rng = random.Random(1)
    rows = [(i, f"P{i % 3}", [(i % 3) * 4 + rng.gauss(0, 0.3), (i % 3 == 1) * 5 + rng.gauss(0, 0.3), rng.gauss(0, 0.01)]) for i in range(120)]
    frames = spark.createDataFrame(rows, "id long, phone string, vector array<double>")
    fitted = C.fit_pca(frames, 0.95)
    assert fitted[2] == 2
    reduced = C.reduce_frames(frames, fitted)
    means = reduced.select(F.avg(F.get("vector", F.lit(0))).alias("a"), F.avg(F.get("vector", F.lit(1))).alias("b")).first()
    assert abs(means["a"]) < 1e-9 and abs(means["b"]) < 1e-9
    scored = C.classify_frames(reduced, C.fit_logreg(reduced))
    assert scored.where("predicted = phone").count() == 120
    flat = C.project_2d(frames, "phone").orderBy("phone").collect()
    assert flat[0]["x"] >= 0 and flat[0]["y"] >= 0 and len(flat) == 3


def test_triplets(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", 0, "_".join(f"{c}{d}" for c, d in zip("ABC", rng.choice(["10", "01", "100", "010", "001"])))) for i in range(60)]
    got = E.stress_triplets(spark.createDataFrame(rows, "word string, alt_idx int, phones string"), 20, "s").collect()
    pattern = {w: "".join(c for c in p if c.isdigit()) for w, _, p in rows}
    assert len(got) == 14  # of lengths two and three; there is no word of four syllables
    for r in got:
        a, b, c = (pattern[r[k]] for k in ("target", "incorrect1", "incorrect2"))
        assert len(a) == len(b) and b == c and a != b and r["incorrect1"] != r["incorrect2"]


def test_contrast_single_phone(spark):
    """A basis of one phone is decided among the allowed ids by probability."""
    rows = spark.createDataFrame(
        [(1, [("X", 0.0, 0.1, [0.1, 0.5, 0.4]), ("Y", 0.1, 0.3, [0.6, 0.1, 0.3])], ["X", "C"], ["X", "C"], ["C"], 1, ["A", "B", "C"])],
        "rec_id long, segments array<struct<found: string, start: double, end: double, probs: array<double>>>, truth array<string>, syllable array<string>, target array<string>, n_basis int, names array<string>",
    )
    assert K.cluster_contrast(rows, {"Q": ["Q"]}, {"Q": ["Q"]}, single=[1, 2]).first()["detection"] == "C"
    assert K.cluster_contrast(rows, {"Q": ["Q"]}, {"Q": ["Q"]}, single=[0, 1]).first()["detection"] == "A"


def test_paths(spark):
    frames = spark.createDataFrame([(1, t, [0.8, 0.2] if t < 2 else [0.1, 0.9]) for t in range(4)], "rec_id long, t long, probs array<double>")
    targets = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "rec_id long, pos long, phone_id long")
    path = K.path_rows(K.force_align(frames, targets), targets).withColumnRenamed("t", "frame_idx")
    got = K.pooled_segments(path, frames.withColumnRenamed("t", "frame_idx")).orderBy("pos").collect()
    assert [(r["pos"], r["phone_id"], r["predicted"], r["n_frames"]) for r in got] == [(0, 0, 0, 2), (1, 1, 1, 2)]


@pytest.mark.parametrize("grid", [2, 100])
def test_grid(spark, monkeypatch, grid):
    """A content list that is cut gives the same pairs as one that is broadcast."""
    monkeypatch.setattr(J, "GRID", grid)
    data = [(i, f"p{i % 9}" if i % 4 else "", f"p{i % 5}" if i % 2 else None, i % 3 > 0) for i in range(30)]
    rows = spark.createDataFrame(data, "rec long, phonetics string, alt_phonetics string, target boolean")
    every = sorted({p for _, p, _, _ in data if p})
    want = sorted((i, e, e in (p, a), not t or e not in (p, a)) for i, p, a, t in data for e in every)
    assert sorted(map(tuple, J.adversary_grid(rows).select("rec", "expected", "match", "should_reject").collect())) == want
