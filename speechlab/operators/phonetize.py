"""Sentences to phonetics: tokens, distinct words, look-ups and syllables, the choice among alternatives, and sentences again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlab.functions import numbers, text
from speechlab.operators import syllables as Y
from speechlab.operators.hot import join_frequent
from speechlab.plans.scratch import kept


def _ordered(order: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def normalized(sentences: DataFrame, key: str = "sent_id") -> DataFrame:
    """``key, sentence, norm, before, after, words, cased, acronyms, lower`` of ``key, text``.

    Marks are glued and blanks squeezed; tokens with digits are told in words (only they are joined, to the distinct ones
    among them), in braces where they become several words; marks at the edges of words are kept apart in maps;
    abbreviations are expanded; letters of acronyms are joined by hyphens.
    """
    glued = F.trim(F.regexp_replace(text.glue_punctuation(F.trim("text")), " +", " "))
    rows = sentences.select(key, glued.alias("sentence")).where("sentence <> ''")
    digits = F.col("sentence").rlike("[0-9]")
    plain = rows.where(~digits).withColumn("norm", F.split("sentence", " "))
    tokens = kept(rows.where(digits).select(key, "sentence", F.posexplode(F.split("sentence", " ")).alias("i", "token")))
    counted = tokens.where(F.col("token").rlike("[0-9]")).groupBy("token").agg(F.count("*").alias("n"))
    told = kept(numbers.number_table(counted).select("token", F.col("words").alias("e")).join(counted, "token"))
    spread = tokens.where(~F.col("token").rlike("[0-9]")).withColumn("e", F.col("token"))
    spread = spread.unionByName(join_frequent(tokens.where(F.col("token").rlike("[0-9]")), told, ["token"]))
    whole = spread.groupBy(key, "sentence").agg(_ordered("i", "token", "e").alias("r")).select(key, "sentence", text.brace_groups(_field("r", "token"), _field("r", "e"))["norm"].alias("n"))
    whole = plain.unionByName(whole.select(key, "sentence", F.split(F.array_join("n", " "), " ").alias("norm")))
    whole = whole.withColumn("maps", text.edge_maps(F.col("norm"))).withColumn("words", text.expand_words(text.strip_marks(F.col("norm"))))
    whole = whole.withColumn("acronyms", text.acronym_indexes(F.col("words")))
    cased = F.transform("words", lambda w: F.when(text.is_acronym(w), F.regexp_replace(w, "(?s)(?<=.)(?=.)", "-")).otherwise(w))
    return whole.select(key, "sentence", "norm", "maps.before", "maps.after", "words", cased.alias("cased"), "acronyms", text.spell_acronyms(F.col("words")).alias("lower"))


def part_alternatives(parts: DataFrame, lexicon: DataFrame, mode: str = "CMU") -> DataFrame:
    """``part, alternatives, last``: of distinct word parts the syllabified alternatives in order, by the word or its folded form, and the last as it is.

    Parts that the lexicon lacks go.
    """
    cut = Y.syllabify(lexicon.select("phones"), "phones", mode).select(F.col("word").alias("phones"), F.array_join("syllables", "|").alias("formatted"))
    known = lexicon.join(cut, "phones").groupBy("word").agg(_ordered("alt_idx", "formatted", "phones").alias("r"))
    known = known.select("word", _field("r", "formatted").alias("a"), F.element_at("r", -1)["phones"].alias("l"))
    # both forms of a part in one join; its own comes first
    forms = F.array_distinct(F.array("part", text.fold_accents(F.col("part"))))
    each = parts.select("part").distinct().select("part", F.posexplode(forms).alias("k", "word")).join(known, "word")
    first = each.groupBy("part").agg(F.min(F.struct("k", "a", "l")).alias("m"))
    return first.select("part", F.col("m.a").alias("alternatives"), F.col("m.l").alias("last"))


def word_table(words: DataFrame, lexicon: DataFrame, dictionary: DataFrame, lang: str, mode: str = "CMU") -> DataFrame:
    """``lower, acronym, syllables, method, alternatives, chosen, bad_count, bad_stress`` of distinct words (``lower, acronym``).

    Hyphenated words are put together from their parts (every combination of alternatives, the last part changing
    fastest), acronyms from the last alternative of each letter. The first alternative is chosen that has as many syllables
    as the text and no stress issue (more primary stresses than parts, or a part without 0 or 1); without one
    it is the first, and what is wrong with it is reported. A word with an unknown part has no alternative.
    """
    distinct = words.select("lower", "acronym").distinct()
    parts = distinct.select("lower", "acronym", F.posexplode(F.split("lower", "-")).alias("k", "part"))
    names = kept(parts.select("part").distinct())
    told = part_alternatives(names, lexicon, mode)
    counts = lexicon.where("alt_idx = 0").select(F.col("word").alias("part"), F.size(F.filter(F.split("phones", "_"), lambda p: Y.sonority(p, mode) == 5)).alias("n_vowels"))
    spelled = names.join(counts, "part", "left")
    cut = Y.syllabified_text(spelled.withColumnRenamed("part", "word"), dictionary, lang).withColumnRenamed("word", "part")
    joined = parts.join(kept(cut.join(told, "part", "left")), "part", "left")
    rows = joined.groupBy("lower", "acronym").agg(_ordered("k", "alternatives", "last", "syllables", "method").alias("r"))

    def widen(done: Column, more: Column) -> Column:
        return F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.concat_ws("-", d, m))))

    lacking = F.exists("r", lambda x: x["last"].isNull())
    several = F.aggregate(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.element_at("r", 1)["alternatives"], lambda a, x: widen(a, x["alternatives"]))
    letters = F.array(F.array_join(_field("r", "last"), "-"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("alternatives", F.when(lacking, none).when(F.col("acronym"), letters).otherwise(several))
    rows = rows.withColumn("syllables", F.when(F.col("acronym"), F.col("lower")).otherwise(F.array_join(_field("r", "syllables"), "-")))
    rows = rows.withColumn("method", F.when(F.col("acronym"), "acronym").otherwise(F.array_join(_field("r", "method"), "-")))
    n_text = F.size(F.split("syllables", r"\|"))
    off = lambda a: F.size(F.split(a, r"\|")) != n_text
    crowded = lambda a: F.regexp_count(a, F.lit("1")) > F.regexp_count(a, F.lit("-")) + 1
    flat = lambda a, marks: F.exists(F.split(a, "-"), lambda p: ~p.rlike(marks))
    good = F.array_position(F.transform("alternatives", lambda a: ~off(a) & ~crowded(a) & ~flat(a, "[01]")), True)
    rows = rows.withColumn("good", good)
    first = F.get("alternatives", F.lit(0))
    unsure = (F.col("good") == 0) & first.isNotNull()
    return rows.select(
        "lower", "acronym", "syllables", "method", "alternatives",
        F.greatest(F.col("good").cast("int") - 1, F.lit(0)).alias("chosen"),
        F.coalesce(unsure & off(first), F.lit(False)).alias("bad_count"),
        F.coalesce(unsure & (crowded(first) | flat(first, "[012]")), F.lit(False)).alias("bad_stress"),
    )


def _told_tokens(tokens: DataFrame, lexicon: DataFrame, dictionary: DataFrame, lang: str, mode: str) -> DataFrame:
    """What distinct tokens (``token``) tell of their sentences: ``token, text, phonetics, segmented, bad_count, bad_stress, methods, alternatives, unknown``.

    Arrays have an entry for each word of the token (a number may have several).
    """
    rows = kept(normalized(tokens.select(F.col("token").alias("told"), F.col("token").alias("text")), "told"))
    each = rows.select("told", F.posexplode(F.arrays_zip("lower", "words")).alias("i", "w"))
    each = each.select("told", "i", "w.lower", text.is_acronym(F.col("w.words")).alias("acronym"))
    # words are looked up once each; those of many tokens do not go through a shuffle
    words = kept(each.groupBy("lower", "acronym").agg(F.count("*").alias("n")))
    table = kept(word_table(words, lexicon, dictionary, lang, mode).join(words, ["lower", "acronym"]))
    found = join_frequent(each, table, ["lower", "acronym"])
    names = ["lower", "syllables", "method", "alternatives", "chosen", "bad_count", "bad_stress"]
    whole = rows.join(found.groupBy("told").agg(_ordered("i", *names).alias("r")), "told")
    chosen = F.transform("r", lambda x: F.get(x["alternatives"], x["chosen"]))
    braces = lambda m: F.map_filter(m, lambda _, v: v.isin("{", "}"))
    compound = text.acronym_compound(chosen, F.col("acronyms"))
    phonetics = F.array_join(text.reattach(compound, braces("before"), braces("after")), " ")
    whole = whole.withColumn("unknown", F.transform(F.filter("r", lambda x: F.size(x["alternatives"]) == 0), lambda x: x["lower"]))
    segmented = text.acronym_compound(text.restore_case(_field("r", "syllables"), F.col("cased")), F.col("acronyms"))
    marks = "".join(c for c in text.MARKS if c not in "{}")
    segmented = F.translate(F.array_join(text.reattach(segmented, F.col("before"), F.col("after")), " "), marks, "")
    bare, raw = text.strip_marks(F.array("sentence")), text.edge_maps(F.array("sentence"))
    return whole.select(
        F.col("told").alias("token"),
        F.array_join(text.reattach(text.acronym_compound(bare, text.acronym_indexes(bare), True), raw["before"], raw["after"]), " ").alias("text"),
        F.when(F.size("unknown") == 0, phonetics).alias("phonetics"), segmented.alias("segmented"),
        _field("r", "bad_count").alias("bad_count"), _field("r", "bad_stress").alias("bad_stress"),
        _field("r", "method").alias("methods"), _field("r", "alternatives").alias("alternatives"), "unknown",
    )


def _looked_up(sentences: DataFrame, lexicon: DataFrame, dictionary: DataFrame, lang: str, mode: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of the sentences in their places (``key, i, token``), and what each distinct one tells (``_told_tokens``) with its number ``n``."""
    glued = F.trim(F.regexp_replace(text.glue_punctuation(F.trim("text")), " +", " "))
    rows = sentences.select(key, glued.alias("sentence")).where((F.col("sentence") != "") & F.col(key).isNotNull())
    each = kept(rows.select(key, F.posexplode(F.split("sentence", " ")).alias("i", "token")))
    counts = kept(each.groupBy("token").agg(F.count("*").alias("n")))
    return each, kept(_told_tokens(counts, lexicon, dictionary, lang, mode).join(counts, "token"))


def _records(each: DataFrame, told: DataFrame, key: str, readable: dict[str, str] | None = None) -> DataFrame:
    """``phonetize`` of tokens that are looked up."""
    columns = [c for c in told.columns if c not in ("token", "n")]
    whole = join_frequent(each, told, ["token"]).groupBy(key).agg(_ordered("i", *columns).alias("r"))
    over = lambda name: F.flatten(_field("r", name))
    line = lambda name: F.array_join(_field("r", name), " ")
    whole = whole.select(key, line("text").alias("text"), line("phonetics").alias("phonetics"), line("segmented").alias("segmented_text"), *[over(c).alias(c) for c in ("bad_count", "bad_stress", "methods", "alternatives", "unknown")])
    whole = whole.withColumn("phonetics", F.when(F.size("unknown") == 0, F.col("phonetics")))
    places = lambda name: F.filter(F.transform(name, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    if readable is None:
        guide = F.lit(None).cast("string")
    else:
        known = F.create_map(*[F.lit(x) for pair in readable.items() for x in pair])
        pieces = F.expr("regexp_extract_all(phonetics, '[A-Za-z]+[0-2]?|[^A-Za-z0-2]+', 0)")
        plain = lambda p: F.regexp_replace(p, "[0-2]$", "")
        guide = F.replace(F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, plain(p)), plain(p))), ""), F.lit("_"), F.lit(""))
    return whole.select(
        key, "text", "phonetics", guide.alias("guide"), "segmented_text",
        places("bad_count").alias("n_syl_mismatches"), places("bad_stress").alias("n_stress_inconsistencies"),
        "methods", F.col("alternatives").alias("phonetics_alt"),
        F.transform("alternatives", F.size).alias("n_alternatives"), "unknown",
    )


def phonetize(sentences: DataFrame, lexicon: DataFrame, dictionary: DataFrame, lang: str = "en", mode: str = "CMU", key: str = "sent_id", readable: dict[str, str] | None = None) -> DataFrame:
    """The linguistic record of each sentence (``key, text``, a row for each key); tokens and words are worked out once for each distinct one.

    Gives ``key, text, phonetics, guide, segmented_text, n_syl_mismatches, n_stress_inconsistencies, methods, phonetics_alt,
    n_alternatives, unknown``: the sentence with braces around acronyms; the chosen phonetics (null if a word is unknown); these
    in readable phones (``readable`` maps them; null without it); the segmented text in its own case; places of words with
    a syllable or stress mismatch; and for each word its way of segmentation and its alternatives. Sentences without words go.
    """
    each, told = _looked_up(sentences, lexicon, dictionary, lang, mode, key)
    return _records(each, told, key, readable)


def phonetize_safe(sentences: DataFrame, lexicon: DataFrame, dictionary: DataFrame, lang: str = "en", mode: str = "CMU", key: str = "sent_id") -> tuple[DataFrame, DataFrame]:
    """Records of the sentences whose words are all known, and ``key, word`` of the others: their first unknown word."""
    each, told = _looked_up(sentences, lexicon, dictionary, lang, mode, key)
    lacking = kept(told.where(F.size("unknown") > 0).select("token", F.get("unknown", F.lit(0)).alias("word"), "n"))
    first = join_frequent(each, lacking, ["token"]).groupBy(key).agg(F.min(F.struct("i", "word"))["word"].alias("word"))
    return _records(each, told, key).where(F.size("unknown") == 0).drop("unknown"), first


def mismatch_report(records: DataFrame, key: str = "sent_id") -> DataFrame:
    """``key, n_words, place, word, phonetics``: sentences with a syllable or stress mismatch, with the word of the first one as segmented and as phones."""
    bad = F.array_sort(F.array_union("n_syl_mismatches", "n_stress_inconsistencies"))
    rows = records.withColumn("place", F.get(bad, F.lit(0))).where("place is not null")
    word = lambda c: F.get(F.split(F.translate(c, "{}", ""), " "), F.col("place"))
    return rows.select(key, F.size("methods").cast("long").alias("n_words"), F.col("place").cast("long").alias("place"), word("segmented_text").alias("word"), word("phonetics").alias("phonetics"))


def repair_from(lexicon: DataFrame, reference: DataFrame, vowels: list[str], syllabic: dict[str, str], heads: tuple[tuple[str, str], ...] = (("f", "θ"),), ending: tuple[str, str, str] | None = None) -> DataFrame:
    """Endings and beginnings of all alternatives, repaired after a sibling lexicon (first alternatives are compared).

    syllabic: plain consonants and their syllabic forms: a word that ends in the plain one after a non-vowel, where the sibling
    ends in the syllabic one, takes it. heads: (wrong, right) first phones. ending: (letters, model word, phone): words in these
    letters whose last two phones are the model word's take the phone as their last.
    """
    phones = F.split("phones", "_")
    own = lexicon.where("alt_idx = 0").select("word", phones.alias("o"))
    other = reference.where("alt_idx = 0").select("word", phones.alias("r"))
    both = own.join(other, "word", "left")
    last = lambda c, k: F.try_element_at(F.col(c), F.lit(-k))
    fix = F.lit(None).cast("string")
    for plain, mark in syllabic.items():
        fix = F.when((last("r", 1) == mark) & (last("o", 1) == plain) & ~last("o", 2).isin(vowels), mark).otherwise(fix)
    head = F.lit(None).cast("string")
    for wrong, right in heads:
        head = F.when((F.get("r", F.lit(0)) == right) & (F.get("o", F.lit(0)) == wrong), right).otherwise(head)
    both = both.select("word", fix.alias("tail"), head.alias("head"), F.slice("o", F.greatest(F.size("o") - 1, F.lit(1)), 2).alias("pair"))
    if ending is not None:
        letters, model, phone = ending
        pair = both.where(F.col("word") == model).select(F.col("pair").alias("model"))  # one row
        both = both.join(F.broadcast(pair), F.lit(True), "left")
        both = both.withColumn("tail", F.when(F.col("word").endswith(letters) & (F.col("pair") == F.col("model")), phone).otherwise(F.col("tail")))
    fixed = lexicon.join(both.select("word", "tail", "head"), "word", "left").withColumn("p", phones)
    p = F.when(F.col("tail").isNotNull(), F.concat(F.slice("p", 1, F.size("p") - 1), F.array("tail"))).otherwise(F.col("p"))
    q = F.when(F.col("head").isNotNull(), F.concat(F.array("head"), F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))))).otherwise(F.col("q"))
    return fixed.withColumn("q", p).select("word", "alt_idx", F.array_join(q, "_").alias("phones"))


def add_schwa_alternative(lexicon: DataFrame, model: DataFrame, reducer: dict[str, str], schwa: str = "ə", token: str = "AH0") -> DataFrame:
    """``lexicon`` with one more alternative, a schwa put in, for words that have such a pair in the ``model`` lexicon.

    The pair's shorter form, without stress, must equal an alternative whose phones are mapped by ``reducer``; new
    alternatives follow the old ones in their order.
    """
    pairs = model.select("word", F.col("alt_idx").alias("x"), F.split("phones", "_").alias("a")).join(model.select("word", F.col("alt_idx").alias("y"), F.split("phones", "_").alias("b")), "word")
    at = F.array_position(F.transform("b", lambda p, i: (p == token) & (F.concat(F.slice("b", F.lit(1), i), F.slice("b", i + 2, F.greatest(F.size("b") - i - 1, F.lit(0)))) == F.col("a"))), True)
    pairs = pairs.where(F.size("b") == F.size("a") + 1).withColumn("at", at).where("at > 0")
    first = pairs.groupBy("word").agg(F.min(F.struct("x", "y", "a", "at")).alias("m")).select("word", F.transform("m.a", lambda p: F.regexp_replace(p, "[012]$", "")).alias("short"), F.col("m.at").alias("at"))
    known = F.create_map(*[F.lit(x) for pair in reducer.items() for x in pair])
    rows = lexicon.join(first, "word").withColumn("p", F.split("phones", "_"))
    rows = rows.where(F.transform("p", lambda x: F.coalesce(F.try_element_at(known, x), x)) == F.col("short"))
    longer = F.concat(F.slice("p", F.lit(1), F.col("at").cast("int") - 1), F.array(F.lit(schwa)), F.slice("p", F.col("at").cast("int"), F.size("p")))
    size = lexicon.groupBy("word").agg((F.max("alt_idx") + 1).alias("n"))
    new = rows.select("word", "alt_idx", F.array_join(longer, "_").alias("phones")).groupBy("word").agg(_ordered("alt_idx", "phones").alias("r")).join(size, "word")
    new = new.select("word", "n", F.posexplode("r").alias("k", "x")).select("word", (F.col("n") + F.col("k")).cast("int").alias("alt_idx"), "x.phones")
    return lexicon.select("word", F.col("alt_idx").cast("int").alias("alt_idx"), "phones").unionByName(new)
