"""Syllables: a sonority syllabifier over distinct words, dictionaries of syllabified words, and rules for endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlab.functions import phonetics as P
from speechlab.plans.scratch import kept

VOWELS = "".join(P.LETTERS["vowel"])
#: Sonority by category; what has none is 0.
SONORITY = {"vowel": 5, "approximant": 4, "nasal": 3, "fricative": 2, "affricate": 1, "stop": 0}
#: Put after each vowel of a phone, so that neighbouring vowels part, and taken out again.
_GLIDE = "\u0001W"


def sonority(symbol: Column, mode: str = "letters") -> Column:
    """Vowel 5, approximant 4, nasal or liquid 3, fricative 2, affricate 1, others 0.

    CMU counts its approximants as liquids (3) and HH as none of these (0).
    """
    kind = P.category(symbol, mode)
    values = F.create_map(*[F.lit(x) for pair in SONORITY.items() for x in pair])
    known = F.coalesce(F.try_element_at(values, kind), F.lit(0))
    if mode == "CMU":
        return F.when(symbol == "HH", 0).when(kind == "approximant", 3).otherwise(known)
    return known


def _cut(words: DataFrame, mode: str) -> DataFrame:
    """``words`` (with ``__s``: symbols) and ``__cuts``: first index and number of symbols of each syllable.

    Symbols and sonorities are columns of their own, so that the cuts are computed from them once.
    """
    glide = {"CMU": 3, "IPA": 3, "MFA_IPA": 4}.get(mode)
    if glide is not None:
        inserted = F.flatten(F.transform("__s", lambda p: F.when(sonority(p, mode) == 5, F.array(p, F.lit(_GLIDE))).otherwise(F.array(p))))
        words = words.withColumn("__s", inserted)
    words = words.withColumn("__son", F.transform("__s", lambda p: F.when(p == _GLIDE, glide).otherwise(sonority(p, mode))))
    son, last = F.col("__son"), F.size("__son") - 1

    def plateau(i: Column) -> Column:
        """A break comes after ``i``: it equals its next, and is its last's equal or below it."""
        return (i > 0) & (i < last) & (F.get(son, i) == F.get(son, i + 1)) & (F.get(son, i) <= F.get(son, F.greatest(i - 1, F.lit(0))))

    def trough(i: Column) -> Column:
        return (i > 0) & (i < last) & (F.get(son, i) < F.get(son, F.greatest(i - 1, F.lit(0)))) & (F.get(son, i) < F.get(son, i + 1))

    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | trough(i) | ((i > 1) & plateau(i - 1)))
    words = words.withColumn("__starts", starts)
    # a part without a vowel joins the one before, leading ones the one after: syllables start where parts with vowels do
    stop = lambda k: F.coalesce(F.get(F.col("__starts"), k + 1), last + 1)
    vowelled = F.filter("__starts", lambda s, k: F.array_contains(F.slice(son, s + 1, stop(k) - s), 5))
    words = words.withColumn("__vowelled", vowelled).withColumn("__n", F.size(F.filter(son, lambda s: s == 5)))
    first = F.transform("__vowelled", lambda s, k: F.when(k == 0, 0).otherwise(s))
    words = words.withColumn("__first", F.when(F.col("__n") == 1, F.array(F.lit(0))).when(F.col("__n") == 0, F.array().cast("array<int>")).otherwise(first))
    return words.withColumn("__cuts", F.transform("__first", lambda s, k: F.struct(s.alias("at"), (F.coalesce(F.get(F.col("__first"), k + 1), last + 1) - s).alias("n"))))


def syllabify(words: DataFrame, col: str = "word", mode: str = "letters") -> DataFrame:
    """``word, syllables`` of the distinct words of a table; a word without a vowel has none.

    Letters: lower-case words. Other modes: phones joined by ``_``, syllables likewise. A syllable breaks before a trough
    of sonority (lower than both neighbours), and after a plateau (equal to the next symbol, and equal to the last or
    below it); a word of one vowel is one syllable; syllables without a vowel join the one before, leading ones the one after.
    """
    # a word is few bytes and much work: as many tasks as a shuffle has, whatever their size
    n_parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.select(F.col(col).alias("word")).where(F.length(col) > 0).distinct().repartition(n_parts, "word")
    symbols = F.filter(F.split("word", ""), lambda x: x != "") if mode == "letters" else F.split("word", "_")
    cut = _cut(distinct.withColumn("__s", symbols), mode)
    joint = "" if mode == "letters" else "_"
    part = lambda x: F.array_join(F.filter(F.slice("__s", x["at"] + 1, x["n"]), lambda p: p != _GLIDE), joint)
    return cut.select("word", F.transform("__cuts", part).alias("syllables"))


def syllables_per_word(tokens: DataFrame) -> DataFrame:
    """``lang, n_syllables, n_words``: counted on distinct words, joined back to word counts by language."""
    counts = kept(tokens.groupBy("lang", "word").agg(F.count("*").alias("n")))  # read twice: texts are not
    sized = syllabify(counts).select("word", F.size("syllables").cast("long").alias("n_syllables"))
    return counts.join(sized, "word").groupBy("lang", "n_syllables").agg(F.sum("n").alias("n_words"))


def format_lexicon(lexicon: DataFrame, mode: str = "CMU") -> DataFrame:
    """``word, phonetics``: the first alternative of each word as syllables apart by ``|``; empty entries go."""
    first = lexicon.where((F.col("alt_idx") == 0) & (F.length("phones") > 0)).select("word", "phones")
    cut = syllabify(first, "phones", mode).select(F.col("word").alias("phones"), "syllables")
    return first.join(cut, "phones").select("word", F.array_join("syllables", "|").alias("phonetics"))


def build_syllable_dict(raw: DataFrame, extra: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``syllables, word, n_syls, n_syls_phones`` of hyphenated English words (``|`` between syllables), with systematic errors repaired.

    ``ire`` is cut (not in ``aire`` and ``oire``), and so are ``ism``, ``ithm`` and ``ythm``; counts come from the text and from
    the first pronunciation (null where the lexicon has none).
    """
    s = F.lower("syllables")
    rows = raw.select("syllables").unionByName(extra.select("syllables")).where("syllables is not null").select(s.alias("syllables"))
    bare = rows.select(F.when(~F.col("syllables").rlike("aire|oire"), F.replace("syllables", F.lit("ire"), F.lit("i|re"))).otherwise(F.col("syllables")).alias("syllables"))
    for old, new in (("ism", "i|sm"), ("ithm", "i|thm"), ("ythm", "y|thm")):
        bare = bare.withColumn("syllables", F.replace("syllables", F.lit(old), F.lit(new)))
    told = bare.select("syllables", F.replace("syllables", F.lit("|"), F.lit("")).alias("word"), F.size(F.split("syllables", r"\|")).cast("long").alias("n_syls"))
    phones = format_lexicon(lexicon).select("word", F.size(F.split("phonetics", r"\|")).cast("long").alias("n_syls_phones"))
    return told.join(phones, "word", "left").select("syllables", "word", "n_syls", "n_syls_phones")


def build_syllable_dict_fr(raw: DataFrame) -> DataFrame:
    """``syllables, word, n_syls, n_syls_phones`` (null) of hyphenated French words ``word, parts, n_syls``.

    Words with a space or hyphen go. A leading ``s-`` or ``ch-`` and a lone ``s``, ``ch``, ``th``, ``n``, ``j`` or ``r`` are glued
    to what follows. Rows whose parts agree with the count stay; of rows with one part too many those that end in e, es, ent,
    -s or e-ment lose their last hyphen, once for each of these endings that they have.
    """
    rows = raw.where("word is not null and parts is not null and n_syls is not null").where(~F.col("word").rlike("[ -]"))
    parts = F.regexp_replace("parts", "^(s|ch)-", "$1")
    for lone in ("s", "ch", "th", "n", "j", "r"):
        parts = F.replace(parts, F.lit(f"-{lone}-"), F.lit(f"-{lone}"))
    rows = rows.select("word", parts.alias("parts"), "n_syls").withColumn("extra", F.size(F.split("parts", "-")) - F.col("n_syls"))
    good = rows.where("extra = 0").select("word", "parts", "n_syls")
    ending = lambda e: F.when(F.col("parts").endswith(e), F.lit(e))
    hits = F.array_compact(F.array(*map(ending, ("e", "es", "ent", "-s", "e-ment"))))
    mended = rows.where("extra = 1").withColumn("hit", F.explode(hits)).select("word", F.regexp_replace("parts", "-([^-]*)$", "$1").alias("parts"), "n_syls")
    return good.unionByName(mended).select(F.replace("parts", F.lit("-"), F.lit("|")).alias("syllables"), "word", F.col("n_syls").cast("long").alias("n_syls"), F.lit(None).cast("long").alias("n_syls_phones"))


def _before_endings(word: Column, lang: str) -> tuple[Column, Column]:
    """A word with the e of its ending taken out, and what must come back: ``ed``, ``es``, ``e`` or null."""
    third, fourth = F.substring(word, F.length(word) - 2, F.lit(1)), F.substring(word, F.length(word) - 3, F.lit(1))
    vowel = lambda c: F.lit(VOWELS).contains(c)
    long = F.length(word) > 3
    if lang.startswith("en"):
        kind = (
            F.when(long & word.endswith("ed") & ~third.isin("t", "d") & ~word.endswith("ired") & ~word.endswith("led"), "ed")
            .when(long & word.endswith("led") & vowel(fourth), "ed")
            .when(long & word.endswith("es") & ~third.isin("s", "c", "g", "x", "z", "j") & ~word.rlike("(ches|shes|ires|les)$"), "es")
            .when(long & word.endswith("les") & vowel(fourth) & (fourth != "e"), "es")
            .when((F.length(word) > 1) & word.endswith("e") & ~word.endswith("le"), "e")
            .when(long & word.endswith("le") & ~third.isin(*P.LETTERS["stop"]), "e")
        )
    elif lang.startswith("fr"):
        kind = F.when(word.endswith("es"), "es").when(word.endswith("e"), "e")
    else:
        kind = F.lit(None).cast("string")
    cut = F.when(kind == "e", F.expr("left(word, length(word) - 1)")).when(kind.isNotNull(), F.concat(F.expr("left(word, length(word) - 2)"), F.right(word, F.lit(1)))).otherwise(word)
    return cut, kind


def _with_endings(syllables: Column, kind: Column, lang: str) -> Column:
    """The taken e put back; English -ism(s) and -ithm(s) are cut."""
    head = F.substring(syllables, F.lit(1), F.length(syllables) - 1)
    out = F.when(kind == "e", F.concat(syllables, F.lit("e"))).when(kind.isNotNull(), F.concat(head, kind)).otherwise(syllables)
    return F.regexp_replace(out, "i(sms?|thms?)$", "i|$1") if lang.startswith("en") else out


def ending_rules(words: DataFrame, lang: str) -> DataFrame:
    """``word, syllables``: distinct words syllabified by letters, with rules for their endings: silent e of -ed, -es and -e, by language."""
    distinct = words.select("word").where(F.length("word") > 0).distinct()
    cut, kind = _before_endings(F.col("word"), lang)
    rows = distinct.select("word", cut.alias("__cut"), kind.alias("__kind"))
    parts = syllabify(rows, "__cut").select(F.col("word").alias("__cut"), F.array_join("syllables", "|").alias("__syl"))
    joined = rows.join(parts, "__cut", "left")
    return joined.select("word", _with_endings(F.coalesce("__syl", F.lit("")), F.col("__kind"), lang).alias("syllables"))


def syllabified_text(words: DataFrame, dictionary: DataFrame, lang: str) -> DataFrame:
    """``word, syllables, method`` of distinct words (``word, n_vowels``), the first of these that applies.

    One vowel: the word itself; a dictionary row whose counts of text and phones agree; any dictionary row (the first by
    its syllables); else letters with the rules for endings.
    """
    distinct = words.groupBy("word").agg(F.min("n_vowels").alias("n_vowels"))
    agree = F.coalesce(F.col("n_syls") == F.col("n_syls_phones"), F.lit(False))
    known = dictionary.withColumn("__agree", agree).groupBy("word").agg(F.min(F.struct((~F.col("__agree")).alias("no"), "syllables"))["syllables"].alias("known"))
    rows = distinct.join(known, "word", "left")
    single = F.coalesce(F.col("n_vowels") == 1, F.lit(False))
    rest = rows.where(~single & F.col("known").isNull())
    told = rows.where(single | F.col("known").isNotNull()).select(
        "word", F.when(single, F.col("word")).otherwise(F.col("known")).alias("syllables"), F.when(single, "1 vowel = 1 syl").otherwise("dataset").alias("method")
    )
    return told.unionByName(ending_rules(rest, lang).withColumn("method", F.lit("sonority")))


def transfer_syllables(pairs: DataFrame, mode: str = "MFA_IPA") -> DataFrame:
    """``word, phones, syllables``: letters of distinct words (``word, phones``) cut where the syllables of their phones start.

    The sonorities of letters and phones are matched by dynamic time warping (steps to the next letter, phone or both; ties
    go to both, then to the letter); a syllable starts at the first letter beside its first phone. The table of a word is
    folded letter by letter, so its cost is the product of the two lengths.
    """
    rows = pairs.select("word", "phones").where((F.length("word") > 0) & (F.length("phones") > 0)).distinct()
    cut = syllabify(rows, "phones", mode).select(F.col("word").alias("phones"), F.col("syllables").alias("__syl"))
    rows = rows.join(cut, "phones").withColumn("__letters", F.filter(F.split("word", ""), lambda x: x != "")).withColumn("__x", F.transform("__letters", lambda x: sonority(x)))
    rows = rows.withColumn("__y", F.transform(F.split("phones", "_"), lambda p: sonority(p, mode)))
    cell = "struct<c: int, b: int>"
    far = lambda x, y: F.abs(x - y).cast("int")
    top = F.aggregate(
        "__y",
        F.array().cast(f"array<{cell}>"),
        lambda a, y: F.concat(a, F.array(F.struct((far(F.get(F.col("__x"), F.lit(0)), y) + F.when(F.size(a) > 0, F.element_at(a, -1)["c"]).otherwise(0)).cast("int").alias("c"), F.lit(2).alias("b")).cast(cell))),
    )

    def row(above: Column, x: Column) -> Column:
        def add(done: Column, y: Column) -> Column:
            j = F.size(done)
            up, side, corner = F.get(above, j)["c"], F.when(j > 0, F.element_at(done, -1)["c"]), F.when(j > 0, F.get(above, F.greatest(j - 1, F.lit(0)))["c"])
            least = F.least(up, side, corner)
            way = F.when(corner == least, 0).when(up == least, 1).otherwise(2)
            return F.concat(done, F.array(F.struct((least + far(x, y)).cast("int").alias("c"), way.alias("b")).cast(cell)))

        return F.aggregate(F.col("__y"), F.array().cast(f"array<{cell}>"), add)

    rows = rows.withColumn("__top", top)
    start = F.struct(F.col("__top").alias("row"), F.array(F.transform("__top", lambda c: c["b"])).alias("back"))

    def step(state: Column, x: Column) -> Column:
        new = row(state["row"], x)
        return F.struct(new.alias("row"), F.concat(state["back"], F.array(F.transform(new, lambda c: c["b"]))).alias("back"))

    rows = rows.withColumn("__back", F.aggregate(F.slice("__x", 2, F.greatest(F.size("__x") - 1, F.lit(0))), start, step, lambda s: s["back"]))
    # back from the last cell: the letter beside each phone, as the path leaves the phone last at its first letter
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size("__x") + F.size("__y")),
        F.struct((F.size("__x") - 1).alias("i"), (F.size("__y") - 1).alias("j"), F.array_repeat(F.lit(0), F.size("__y")).alias("at")),
        lambda s, _: F.when((s["j"] < 0) | (s["i"] < 0), s).otherwise(_back_step(s)),
        lambda s: s["at"],
    )
    rows = rows.withColumn("__at", walk)
    sizes = F.transform("__syl", lambda s: F.size(F.split(s, "_")))
    rows = rows.withColumn("__sizes", sizes)
    first = F.transform("__sizes", lambda n, k: F.when(k == 0, 0).otherwise(F.get(F.col("__at"), F.aggregate(F.slice("__sizes", F.lit(1), k), F.lit(0), lambda a, v: a + v))))
    rows = rows.withColumn("__first", first)
    part = lambda s, k: F.array_join(F.slice("__letters", s + 1, F.greatest(F.coalesce(F.get(F.col("__first"), k + 1), F.size("__letters")) - s, F.lit(0))), "")
    return rows.select("word", "phones", F.transform("__first", part).alias("syllables"))


def _back_step(s: Column) -> Column:
    """One step back from a cell, whose letter becomes the (so far) first one beside its phone."""
    way = F.get(F.get(F.col("__back"), s["i"]), s["j"])
    at = F.transform(s["at"], lambda v, k: F.when(k == s["j"], s["i"]).otherwise(v))
    i = F.when((way == 0) | (way == 1), s["i"] - 1).otherwise(s["i"])
    j = F.when((way == 0) | (way == 2), s["j"] - 1).otherwise(s["j"])
    return F.struct(i.alias("i"), j.alias("j"), at.alias("at"))

