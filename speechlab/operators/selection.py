"""Selections of words by their phones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlab.functions import phonetics as P
from speechlab.functions.text import strip_marks
from speechlab.operators.hot import join_frequent
from speechlab.operators.syllables import syllabify
from speechlab.operators.windows import first_per_key, sample_n
from speechlab.plans.scratch import kept


def ending_class(word: Column, phones: Column) -> Column:
    """Class of a final -ed or -s, or of an initial h, by its sound; null for other words."""
    return (
        F.when(word.endswith("ed") & phones.rlike("_[A-Z]+0_D$"), "ed:syllable")
        .when(word.endswith("ed") & phones.endswith("_T"), "ed:T")
        .when(word.endswith("ed") & phones.endswith("_D"), "ed:D")
        .when(word.endswith("s") & phones.rlike("_[AI]H0_Z$"), "s:syllable")
        .when(word.endswith("s") & phones.endswith("_S"), "s:S")
        .when(word.endswith("s") & phones.endswith("_Z"), "s:Z")
        .when(word.startswith("h") & phones.startswith("HH"), "h:sounded")
        .when(word.startswith("h"), "h:silent")
    )


def select_words(df: DataFrame, value: str, column: str, option: str, word: str = "word", letters: str | None = None) -> DataFrame:
    """Rows whose ``column`` contains, starts or ends with ``value`` (option: contains | startswith | endswith), and whose word does so with ``letters``."""
    out = df.where(getattr(F.col(column), option)(value))
    return out if letters is None else out.where(getattr(F.col(word), option)(letters))


def target_syllable(df: DataFrame, phone: str, column: str = "phonetics") -> DataFrame:
    """``syl``: index of the first syllable of a word that has the phone; words without it go."""
    hit = F.transform(F.split(column, r"\|"), lambda s: F.array_contains(F.split(s, "_"), phone))
    return df.withColumn("syl", (F.array_position(hit, True) - 1).cast("long")).where("syl >= 0")


def cluster_selection(df: DataFrame, column: str, cluster: str, side: str, n: int, key: str) -> DataFrame:
    """A sample of ``n`` rows whose phones have the cluster at their start or end."""
    test = F.col(column).startswith(cluster) if side == "start" else F.col(column).endswith(cluster)
    return sample_n(df.where(test), key, n, cluster)


def frequent_by_phone(words: DataFrame, phones: list[str], n: int) -> DataFrame:
    """``rank`` and a column for each phone: its ``n`` most frequent words; missing ranks are null."""
    each = words.withColumn("phone", F.explode(F.array_distinct(F.split("phones", "_")))).where(F.col("phone").isin(phones))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("phone").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= n)
    return ranked.groupBy("rank").pivot("phone", phones).agg(F.first("word"))


def inject_ending(text: Column, position: Column, ending: str) -> Column:
    """A sentence's phonetics, words between blanks, with an ending on the word at ``position`` (from 0)."""
    return F.array_join(F.transform(F.split(text, " "), lambda w, i: F.when(i == position, F.concat(w, F.lit(ending))).otherwise(w)), " ")


def select_accent(path: Column, accent: str, known: tuple[str, ...]) -> Column:
    """Whether the base name of a path has the accent; an accent that is not known raises."""
    if accent not in known:
        raise ValueError(f"unknown accent {accent!r}")
    return F.element_at(F.split(path, "/"), -1).contains(accent)


def clean_word_list(df: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """Lines without their numbering (``12.`` or ``3)``), lower-cased, that are words of the lexicon."""
    word = F.lower(F.regexp_replace(F.trim(F.col(column)), r"^[0-9]+[.)] *", ""))
    return df.withColumn("word", word).join(lexicon.select("word").distinct(), "word", "left_semi")


def words_with_phone(lexicon: DataFrame, phone: str, n: int, seed: str) -> DataFrame:
    """The first ``n`` words, in the order of the md5 of word and seed, that have the phone (a sampling operator)."""
    return sample_n(lexicon.where(F.array_contains(F.split("phones", "_"), phone)), "word", n, seed)


def phone_strength(lexicon: DataFrame, patterns: list[str]) -> DataFrame:
    """``strength``: number of phones that match any pattern; words without one go."""
    hits = F.size(F.filter(F.split("phones", "_"), lambda p: p.rlike("|".join(f"(?:{x})" for x in patterns))))
    return lexicon.withColumn("strength", hits.cast("long")).where("strength > 0")


def stress_groups(lexicon: DataFrame) -> DataFrame:
    """``word, n_syll, pattern, n_words``: each word with the size of the group of its stress pattern."""
    pattern = F.array_join(F.transform(F.filter(F.split("phones", "_"), lambda p: p.rlike("[0-2]$")), lambda p: F.right(p, F.lit(1))), "")
    words = lexicon.select("word", F.length(pattern).cast("long").alias("n_syll"), pattern.alias("pattern"))
    return words.join(words.groupBy("pattern").agg(F.count("*").alias("n_words")), "pattern")


def contrast_pairs(pairs: DataFrame, lexicon: DataFrame, one: str, other: str) -> DataFrame:
    """``a, b`` pairs of which one word has a phone of the first pattern and the other one of the second, once each."""
    marks = lexicon.groupBy("word").agg(F.max(F.col("phones").rlike(one)).alias("one"), F.max(F.col("phones").rlike(other)).alias("other"))
    both = pairs.join(marks.select(F.col("word").alias("a"), F.col("one").alias("a1"), F.col("other").alias("a2")), "a")
    both = both.join(marks.select(F.col("word").alias("b"), F.col("one").alias("b1"), F.col("other").alias("b2")), "b")
    return both.where("(a1 and b2) or (a2 and b1)").select("a", "b").distinct()


def odd_one_out(lexicon: DataFrame, a: str, b: str, n: int, seed: str) -> DataFrame:
    """``n`` triplets: the k-th sampled word of class ``a`` with the two next ones of class ``b``; classes are patterns of phones."""
    order = Window.orderBy(F.md5(F.concat_ws("-", "word", F.lit(seed))), "word")
    odd = sample_n(lexicon.where(F.col("phones").rlike(a) & ~F.col("phones").rlike(b)), "word", n, seed)
    rest = sample_n(lexicon.where(F.col("phones").rlike(b) & ~F.col("phones").rlike(a)), "word", 2 * n, seed)
    odd = odd.select((F.row_number().over(order) - 1).alias("k"), F.col("word").alias("odd"))
    rest = rest.select("word", (F.row_number().over(order) - 1).alias("r")).withColumn("k", F.floor(F.col("r") / 2).cast("int"))
    pairs = rest.groupBy("k").agg(F.min_by("word", "r").alias("first"), F.max_by("word", "r").alias("second"), F.count("*").alias("c")).where("c = 2")
    return odd.join(pairs, "k").select("odd", "first", "second")


# Voiceless phones, and the forms that each sound of the ending -ed is accepted in.
VOICELESS = ["CH", "F", "HH", "K", "P", "S", "SH", "T", "TH"]
ACCEPTED = {"IH0_D": ["IH0_D", "IH1_D", "IH2_D"], "D": ["D", "D_AH0"], "T": ["T", "T_AH0"]}


def voicing_rule(phone: Column) -> Column:
    """The ending -ed takes after a phone."""
    return F.when(phone.isin("T", "D"), "IH0_D").when(phone.isin(*VOICELESS), "T").otherwise("D")


def ending_rules_table(spark: SparkSession) -> DataFrame:
    """``phone, ending, accepted``: for every consonant the sound of -ed after it, and the accepted forms of that sound."""
    consonants = sorted({p for ps in P.CATEGORIES.values() for p in ps})
    rows = [(p, e := "IH0_D" if p in ("T", "D") else "T" if p in VOICELESS else "D", ACCEPTED[e]) for p in consonants]
    return spark.createDataFrame(rows, "phone string, ending string, accepted array<string>")


def select_ed(words: DataFrame, n: int) -> DataFrame:
    """``phone, ending, word, rank``: the ``n`` most frequent words (``word, phones, n``) in -ed for each phone before an ending that follows its rule."""
    rules = F.broadcast(ending_rules_table(words.sparkSession))
    rows = words.where(F.col("word").endswith("ed"))
    size = F.size(F.split("phones", "_"))
    before = lambda k: F.try_element_at(F.split("phones", "_"), (-F.lit(k + 1)).cast("int"))
    long = F.col("phones").rlike("_IH[0-2]_D$")
    rows = rows.withColumn("phone", F.when(long & (size > 2), before(2)).otherwise(before(1)))
    rows = rows.withColumn("said", F.when(long, F.regexp_extract("phones", "IH[0-2]_D$", 0)).otherwise(F.element_at(F.split("phones", "_"), -1)))
    ruled = rows.join(rules, "phone").where(F.array_contains("accepted", F.col("said")))
    rank = F.row_number().over(Window.partitionBy("phone").orderBy(F.desc("n"), "word", "phones"))
    return ruled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("phone", "ending", "word", "rank")


def tagged_union(parts: list[tuple[str, DataFrame]], tag: str = "source") -> DataFrame:
    """The rows of several tables, also with different columns (nulls where one lacks a column), with the name of each."""
    named = [df.withColumn(tag, F.lit(name)) for name, df in parts]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def inventory_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``column, side``: each value of either inventory, with ``left``, ``right`` or ``both``."""
    rows = a.select(column, F.lit(1).alias("s")).unionByName(b.select(column, F.lit(2).alias("s")))
    side = F.bit_or("s")
    return rows.groupBy(column).agg(F.when(side == 3, "both").when(side == 1, "left").otherwise("right").alias("side"))


def format_selection(selection: DataFrame, words: DataFrame, target: str | None = None) -> DataFrame:
    """``file_id, word_idx, phonetics, syllable``: selected words beside the formatted phonetics of their file.

    selection: ``file_id, word_idx``; words: ``file_id, word_idx, phones`` (joined by ``_``; empty or null: ``AH0``). syllable: the
    first of the word that has ``target`` (null without it), or -1, the last, if no target is given.
    """
    filled = words.select("file_id", "word_idx", F.when(F.length("phones") > 0, F.col("phones")).otherwise("AH0").alias("phones"))
    filled = kept(first_per_key(filled, ["file_id", "word_idx"], ["phones"]))  # read twice
    counts = kept(filled.groupBy("phones").agg(F.count("*").alias("n")))
    cut = syllabify(counts, "phones", "CMU").select(F.col("word").alias("phones"), F.array_join("syllables", "|").alias("s"))
    # words without phones are one key of most rows
    told = join_frequent(filled, kept(cut.join(counts, "phones")), ["phones"])
    said = told.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", F.when(F.col("s") != "", F.col("s")).otherwise(F.col("phones")).alias("s")))).alias("r"))
    rows = selection.join(said, "file_id")
    own = F.get(F.transform(F.filter("r", lambda x: x["word_idx"] == F.col("word_idx")), lambda x: x["s"]), F.lit(0))
    hit = F.array_position(F.transform(F.split(own, r"\|"), lambda s: F.array_contains(F.split(s, "_"), target or "")), True)
    syllable = F.lit(-1).cast("long") if target is None else F.nullif(hit - 1, F.lit(-1).cast("long"))
    return rows.select("file_id", "word_idx", F.array_join(F.transform("r", lambda x: x["s"]), " ").alias("phonetics"), syllable.alias("syllable"))


def annotated_selection(df: DataFrame, silent_rule: str = "without the sound h at the beginning") -> DataFrame:
    """``word_idx, word, syllable, kind`` of sentences with one starred word (``text, phonetics, rule``); others go.

    kind: of words in s the sound of the ending (``s:syllable``, ``s:S``, ``s:Z``), of words in h ``h:silent`` by the annotated
    rule, else ``h:sounded``. syllable: the first with HH for a sounded h, 0 for a silent one, -1 (the last) for endings.
    """
    at = F.array_position(F.transform(F.split("text", " "), lambda w: w.contains("*")), True) - 1
    rows = df.withColumn("word_idx", at.cast("long")).where("word_idx >= 0")
    word = F.lower(F.get(strip_marks(F.split("text", " ")), F.col("word_idx").cast("int")))
    rows = rows.withColumn("word", word).withColumn("__p", F.get(F.split("phonetics", " "), F.col("word_idx").cast("int"))).where("__p is not null")
    flat = F.replace("__p", F.lit("|"), F.lit("_"))
    ending = F.when(flat.rlike("[AI]H0_Z$"), "s:syllable").when(flat.endswith("_S"), "s:S").otherwise("s:Z")
    hh = F.array_position(F.transform(F.split("__p", r"\|"), lambda s: s.contains("HH")), True) - 1
    kind = F.when(F.col("word").startswith("h"), F.when(F.col("rule") == silent_rule, "h:silent").otherwise("h:sounded")).when(F.col("word").endswith("s"), ending)
    rows = rows.withColumn("kind", kind).where("kind is not null")
    syllable = F.when(F.col("kind") == "h:silent", 0).when(F.col("kind") == "h:sounded", hh).otherwise(-1)
    return rows.withColumn("syllable", syllable.cast("long")).where("kind <> 'h:sounded' or syllable >= 0").drop("__p")


# exercises
def polysyllables(lexicon: DataFrame, n: int, seed: str, least: int = 2) -> DataFrame:
    """``n`` words of at least ``least`` syllables (a sampling operator)."""
    return sample_n(lexicon.where(F.regexp_count("phones", F.lit("[012]")) >= least).select("word"), "word", n, seed)


def stress_triplets(lexicon: DataFrame, n: int, seed: str, shares: tuple[tuple[int, int], ...] = ((2, 3), (3, 4), (4, 3))) -> DataFrame:
    """``n_syll, target, incorrect1, incorrect2``: a word, and two of another stress pattern of the same number of syllables.

    shares: weights of the lengths: ``n`` is dealt to them, rounded down. Targets, the other pattern and the place of its two
    words follow the md5 of word and seed (a sampling operator); a length with a single pattern gives none.
    """
    rows = stress_groups(lexicon.where("alt_idx = 0")).where(F.col("n_words") >= 1)
    key = lambda *c: F.md5(F.concat_ws("-", *c, F.lit(seed)))
    total = sum(w for _, w in shares)
    quota = F.create_map(*[F.lit(x) for k, w in shares for x in (k, n * w // total)])
    ranked = rows.withColumn("quota", F.try_element_at(quota, F.col("n_syll").cast("int"))).where("quota is not null")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("n_syll", "pattern").orderBy(key("word"), "word")) - 1)
    patterns = ranked.groupBy("n_syll", "pattern").agg(F.count("*").alias("size")).where("size >= 2")  # few: strings of stress digits
    others = patterns.select("n_syll", F.col("pattern").alias("other"), "size")
    picked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("n_syll").orderBy(key("word"), "word"))).where("r <= quota")
    chosen = picked.join(F.broadcast(others), "n_syll").where("pattern <> other")
    chosen = chosen.groupBy("n_syll", "word").agg(F.min_by(F.struct("other", "size"), F.struct(key("word", "other"), "other")).alias("o"))
    at = F.pmod(F.conv(F.substring(key("word"), 1, 8), 16, 10).cast("long"), F.col("o.size") - 1)
    chosen = chosen.select("n_syll", "word", F.col("o.other").alias("pattern"), at.alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    words = ranked.select("n_syll", "pattern", F.col("place").cast("long").alias("place"), F.col("word").alias("w"))
    both = chosen.withColumn("place", F.col("at") + F.col("d")).join(words, ["n_syll", "pattern", "place"])
    return both.groupBy("n_syll", F.col("word").alias("target")).agg(F.min_by("w", "d").alias("incorrect1"), F.max_by("w", "d").alias("incorrect2"))


def fix_focus(sentences: DataFrame, lexicon: DataFrame, patterns: list[str], key: str = "sent_id") -> DataFrame:
    """Sentences (``key, text``) whose starred word has a phone of the patterns; else the star goes to the best word; without one they go.

    The best word has the most matching phones times letters, the first of equals.
    """
    hit = "|".join(f"(?:{p})" for p in patterns)
    hits = lexicon.where("alt_idx = 0").select("word", F.size(F.filter(F.split("phones", "_"), lambda p: p.rlike(hit))).alias("hits")).where("hits > 0")
    rows = sentences.select(key, F.posexplode(F.split("text", " ")).alias("i", "token")).withColumn("word", F.lower(F.get(strip_marks(F.array("token")), F.lit(0))))
    scored = rows.join(hits, "word", "left").withColumn("score", F.coalesce("hits", F.lit(0)) * F.length("word"))
    starred = F.max(F.when(F.col("token").rlike(r"\*[A-Za-z]+\*"), F.col("score")).otherwise(0)) > 0
    best = F.max(F.struct("score", (-F.col("i")).alias("i")))
    told = scored.groupBy(key).agg(starred.alias("ok"), best["score"].alias("top"), (-best["i"]).alias("at")).where("ok or top > 0")
    joined = sentences.join(told, key)
    moved = F.transform(F.split(F.replace("text", F.lit("*"), F.lit("")), " "), lambda w, i: F.when(i == F.col("at"), F.concat(F.lit("*"), w, F.lit("*"))).otherwise(w))
    return joined.withColumn("text", F.when(F.col("ok"), F.col("text")).otherwise(F.array_join(moved, " "))).drop("ok", "top", "at")


def filter_cards(cards: DataFrame, lexicon: DataFrame, kind: str, vowels: str = "(?:IH|IY)[012]") -> DataFrame:
    """Cards (``text``) whose starred word ends in -ed (kind ``ed``), or has a vowel of the pattern in its first alternative (kind ``vowel``)."""
    rows = cards.withColumn("__w", F.replace(F.regexp_extract("text", r"\*.+\*", 0), F.lit("*"), F.lit(""))).where("__w <> ''")
    if kind == "ed":
        return rows.where(F.col("__w").endswith("ed")).drop("__w")
    known = lexicon.where("alt_idx = 0").where(F.col("phones").rlike(vowels)).select(F.col("word").alias("__w"))
    return rows.join(known, "__w", "left_semi").drop("__w")


def parse_dialogues(df: DataFrame, column: str = "line") -> DataFrame:
    """``question, answer`` of lines ``question | answer``; lines without exactly one bar go."""
    parts = F.split(column, r"\|")
    return df.where(F.size(parts) == 2).withColumn("question", F.trim(parts[0])).withColumn("answer", F.trim(parts[1]))


def starred(df: DataFrame, n: int, key: str, column: str = "text") -> DataFrame:
    """The first ``n`` rows, by key, with a starred word (the cap is the feature)."""
    return df.where(F.col(column).contains("*")).orderBy(key).limit(n)


def parse_records(df: DataFrame, min_stars: int, n: int, key: str, column: str = "line") -> DataFrame:
    """``record``: the first ``n`` lines, by key, that hold an object of texts with at least ``min_stars`` starred words; malformed lines go."""
    stars = F.regexp_count(column, F.lit(r"\*[^\s*]+\*")) >= min_stars
    body = F.regexp_replace(F.trim(column), r"^[0-9]+[.)] *", "")
    rows = df.where(stars).withColumn("record", F.from_json(F.when(body.rlike(r"^\{[^{}]*\}$"), body), "map<string,string>")).where("record is not null")
    return rows.orderBy(key).limit(n)


def ed_pairs(df: DataFrame, seed: str, column: str = "line") -> DataFrame:
    """``target, incorrect`` of lines ``a/b`` whose both words end in -ed; the md5 of line and seed chooses the side."""
    line = F.lower(F.regexp_replace(F.trim(column), r"^[0-9]+[.)] *", ""))
    rows = df.select("*", F.explode(F.array(line)).alias("__l"))  # a row of its own for the line, which is worked out once
    parts = F.split("__l", "/")
    rows = rows.withColumn("__a", F.trim(F.get(parts, F.lit(0)))).withColumn("__b", F.trim(F.get(parts, F.lit(1))))
    rows = rows.where(F.col("__a").endswith("ed") & F.col("__b").endswith("ed"))
    first = F.substring(F.md5(F.concat_ws("-", "__l", F.lit(seed))), 1, 1) < "8"
    return rows.withColumn("target", F.when(first, F.col("__a")).otherwise(F.col("__b"))).withColumn("incorrect", F.when(first, F.col("__b")).otherwise(F.col("__a"))).drop("__l", "__a", "__b")
