"""Pronunciation lexicons: ``word, alt_idx, phones`` with phones joined by ``_``; alternatives are ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlab.functions import phonetics


def override(base: DataFrame, patch: DataFrame) -> DataFrame:
    """A patch replaces all alternatives of its words."""
    return base.join(patch.select("word").distinct(), "word", "left_anti").unionByName(patch)


def derive_clitics(lexicon: DataFrame, clitic: str, phone: str) -> DataFrame:
    """Forms with a clitic that the lexicon lacks: the stem's alternatives with one more phone."""
    forms = lexicon.select(F.concat("word", F.lit(clitic)).alias("word"), "alt_idx", F.concat_ws("_", "phones", F.lit(phone)).alias("phones"))
    return forms.join(lexicon.select("word").distinct(), "word", "left_anti")


def derive_forms(lexicon: DataFrame, forms: DataFrame, endings: dict[str, list[tuple[tuple[str, ...], str]]], corrections: DataFrame | None = None) -> DataFrame:
    """``word, alt_idx, phones`` of given forms (``word``): stem and clitic, looked up by the stem; corrections replace what is derived.

    endings: for each clitic its phones by the stem's last phone, the first that applies (an empty tuple applies always). Forms
    whose stem is unknown go; a form that ends in several clitics takes the longest.
    """
    rows = forms.select("word").distinct()
    clitic = F.coalesce(*[F.when(F.col("word").endswith(c), F.lit(c)) for c in sorted(endings, key=lambda c: (-len(c), c))])
    rows = rows.withColumn("c", clitic).where("c is not null").withColumn("stem", F.substring("word", F.lit(1), F.length("word") - F.length("c")))
    stems = lexicon.select(F.col("word").alias("stem"), "alt_idx", "phones")
    last = F.element_at(F.split("phones", "_"), -1)
    phone = F.lit(None).cast("string")
    for c, cases in endings.items():
        chosen = F.lit(None).cast("string")
        for after, p in reversed(cases):
            chosen = F.when(last.isin(*after), p).otherwise(chosen) if after else F.lit(p)
        phone = F.when(F.col("c") == c, chosen).otherwise(phone)
    out = rows.join(stems, "stem").withColumn("p", phone).where("p is not null")
    out = out.select("word", F.col("alt_idx").cast("int").alias("alt_idx"), F.concat_ws("_", "phones", "p").alias("phones"))
    return out if corrections is None else override(out, corrections.select("word", F.col("alt_idx").cast("int").alias("alt_idx"), "phones"))


def one_diff_words(lexicon: DataFrame) -> DataFrame:
    """``word, token, idx``: words with two alternatives that differ by one inserted phone; the first such pair."""
    a = lexicon.select("word", F.col("alt_idx").alias("a_idx"), F.split("phones", "_").alias("a"))
    b = lexicon.select("word", F.col("alt_idx").alias("b_idx"), F.split("phones", "_").alias("b"))
    pairs = a.join(b, "word").where("a_idx < b_idx").withColumn("idx", phonetics.one_insertion(F.col("a"), F.col("b"))).where("idx is not null")
    first = F.row_number().over(Window.partitionBy("word").orderBy("a_idx", "b_idx"))
    return pairs.withColumn("r", first).where("r = 1").select("word", F.element_at("b", F.col("idx") + 1).alias("token"), "idx")


def phone_inventory(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.explode(F.split("phones", "_")).alias("phone")).distinct()


def alternatives_histogram(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("word").agg(F.count("*").alias("n_alternatives")).groupBy("n_alternatives").agg(F.count("*").alias("n_words"))


def lookup(words: DataFrame, lexicon: DataFrame, fold, oov: DataFrame | None = None) -> DataFrame:
    """``word, phones, how``: the first alternative, by the word itself, then by its folded form, then in the ``oov`` table; else null and ``none``.

    oov: ``word, phones``. Both forms of a word meet the lexicon in one join (and the oov table, told apart by its rank), and
    the best of what is found is a minimum over the word's few rows.
    """
    known = lexicon.where("alt_idx = 0").groupBy("word").agg(F.min("phones").alias("phones")).withColumn("given", F.lit(False))
    if oov is not None:
        known = known.unionByName(oov.groupBy("word").agg(F.min("phones").alias("phones")).withColumn("given", F.lit(True)))
    forms = F.array_distinct(F.array("word", fold(F.col("word"))))
    each = words.select("word").distinct().select("word", F.posexplode(forms).alias("k", "form"))
    found = each.join(known.withColumnRenamed("word", "form"), "form", "left")
    # an oov entry holds for the word itself only
    rank = F.when(F.col("phones").isNull() | (F.col("given") & (F.col("k") > 0)), 3).when(F.col("given"), 2).otherwise(F.col("k"))
    best = found.groupBy("word").agg(F.min(F.struct(rank.cast("int").alias("rank"), "phones")).alias("m"))
    how = F.get(F.array(*map(F.lit, ("exact", "folded", "oov", "none"))), F.col("m.rank"))
    return best.select("word", F.when(F.col("m.rank") < 3, F.col("m.phones")).alias("phones"), how.alias("how"))


def letter_names(lexicon: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """``letter, alt_idx, phones``: the longest pronunciation of each one-letter word (of equals the first), then fixed letters replaced or added."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.size(F.split("phones", "_")).desc(), "alt_idx"))
    longest = lexicon.where(F.length("word") == 1).withColumn("r", rank).where("r = 1").select("word", F.lit(0).alias("alt_idx"), "phones")
    out = longest if fixes is None else override(longest, fixes.select("word", F.col("alt_idx").cast("int").alias("alt_idx"), "phones"))
    return out.withColumnRenamed("word", "letter")


def mismatch_kind(n_vowels: Column, expected: Column, primaries: Column, parts: Column) -> Column:
    """What is wrong with a chosen alternative: ``n_syl``, ``stress``, ``n_syl+stress``, or null."""
    off, crowded = n_vowels != expected, primaries > parts
    return F.when(off & crowded, "n_syl+stress").when(off, "n_syl").when(crowded, "stress")


def variant_table(tables: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """One column for each named variant of a value, side by side by key; keys that a variant lacks have null there."""
    out = tables[0][1].select(key, F.col(value).alias(tables[0][0]))
    for name, df in tables[1:]:
        out = out.join(df.select(key, F.col(value).alias(name)), key, "full")
    return out


def agreement(words: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Share, in percent, of words whose syllable count is the expected one."""
    joined = words.join(expected, "word")
    return joined.groupBy(*by).agg((F.lit(100.0) * F.avg((F.col("n_text") == F.col("n_phone")).cast("double"))).alias("agreement"), F.count("*").alias("n"))


def derive_elisions(lexicon: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Elided forms: each (prefix, its phones) before every word whose first alternative starts with a vowel."""
    vowel = lexicon.where("alt_idx = 0").where(F.regexp_extract("phones", "^[^_]*", 0).rlike("[012]$"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in prefixes]))
    spread = vowel.withColumn("x", each)
    return spread.select(F.concat("x.p", "word").alias("word"), F.concat_ws("_", "x.s", "phones").alias("phones"))


def fix_rhotics(lexicon: DataFrame, diphthongs: list[str], rhotic: str = "R", merged: str = "ER0") -> DataFrame:
    """A rhotic after a diphthong, at the end or before a non-vowel, becomes ``merged``."""
    x = F.split("phones", "_")

    def one(p, i):
        before, after = F.get(x, i - 1), F.get(x, i + 1)
        return F.when((p == rhotic) & before.isin(diphthongs) & (after.isNull() | ~after.rlike("[012]$")), merged).otherwise(p)

    return lexicon.withColumn("phones", F.array_join(F.transform(x, one), "_"))


def invert(df: DataFrame, value: str, key: str) -> DataFrame:
    """Each value with the sorted keys that have it."""
    return df.groupBy(value).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def stress_issues(lexicon: DataFrame) -> DataFrame:
    """``word, alt_idx, primaries, issues``: more primary stresses than hyphen parts, or no stress digit at all."""
    primaries = (F.length("phones") - F.length(F.replace("phones", F.lit("1"), F.lit("")))).cast("long")
    parts = F.size(F.split("word", "-"))
    issues = (primaries > parts).cast("long") + (~F.col("phones").rlike("[01]")).cast("long")
    return lexicon.select("word", "alt_idx", primaries.alias("primaries"), issues.alias("issues"))


def vowel_counts(lexicon: DataFrame) -> DataFrame:
    """``word, alt_idx, n_vowels`` of every alternative: phones that carry a stress digit."""
    return lexicon.select("word", "alt_idx", F.size(F.filter(F.split("phones", "_"), lambda p: p.rlike("[012]$"))).cast("long").alias("n_vowels"))


def choose_alternative(lexicon: DataFrame, expected: DataFrame) -> DataFrame:
    """``word, alt_idx, matched``: the first alternative with the expected count ``n_text`` and no stress issue, else the first."""
    scored = vowel_counts(lexicon).join(stress_issues(lexicon), ["word", "alt_idx"]).join(expected, "word")
    good = (F.col("n_vowels") == F.col("n_text")) & (F.col("issues") == 0)
    best = F.min(F.when(good, F.col("alt_idx")))
    return scored.groupBy("word").agg(F.coalesce(best, F.lit(0)).cast("long").alias("alt_idx"), best.isNotNull().alias("matched"))


def first_phones(tokens: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts whose words are all known, with their phones; and the other texts with their first unknown word."""
    first = lexicon.where("alt_idx = 0").select("word", "phones")
    joined = tokens.join(first, "word", "left")
    order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "phones"))), lambda x: x["phones"])
    lacking = F.count_if(F.col("phones").isNull())
    each = joined.groupBy("doc_id").agg(order.alias("phones"), lacking.alias("lacking"))
    ok = each.where("lacking = 0").select("doc_id", F.array_join("phones", "|").alias("phonetics"))
    # only unknown words are sorted and grouped for the other texts
    bad = joined.where("phones is null").groupBy("doc_id").agg(F.min(F.struct("pos", "word")).alias("bad"))
    return ok, bad.select("doc_id", F.col("bad.pos").cast("long").alias("pos"), F.col("bad.word").alias("word"))


def diff_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """``ending, n``: words whose two phonetisations differ, by the ending of the second."""
    differ = a.select("word", F.col("phones").alias("old")).join(b.select("word", F.col("phones").alias("new")), "word").where("old <> new")
    return differ.groupBy(F.element_at(F.split("new", "_"), -1).alias("ending")).agg(F.count("*").alias("n"))


def apply_filters(df: DataFrame, specs: list[tuple[str, bool, str, str]]) -> DataFrame:
    """Rows that meet every (column, whether it does, startswith | endswith | contains, value)."""
    for column, does, how, value in specs:
        test = getattr(F.col(column), how)(value)
        df = df.where(test if does else ~test)
    return df
