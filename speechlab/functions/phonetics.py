"""Formatted phonetics: ``" "`` between words, ``|`` between syllables, ``_`` between phones; stress digits on vowels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_phonetics(col: Column) -> Column:
    """Words of syllables of phones."""
    return F.transform(F.split(col, " "), lambda w: F.transform(F.split(w, r"\|"), lambda s: F.split(s, "_")))


def split_by_word(col: Column) -> Column:
    return F.transform(F.split(F.replace(col, F.lit("|"), F.lit("_")), " "), lambda w: F.split(w, "_"))


def phones(col: Column) -> Column:
    return F.split(col, r"[ |_]")


def n_syllables(col: Column) -> Column:
    return F.size(F.split(col, r"[ |]"))


def index_phones(df: DataFrame, col: str, key: str) -> DataFrame:
    """``key, word_idx, syl_idx, phone_idx, phone``; syllables are numbered within their word."""
    words = df.select(key, F.posexplode(split_phonetics(F.col(col))).alias("word_idx", "w"))
    syllables = words.select(key, "word_idx", F.posexplode("w").alias("syl_idx", "s"))
    return syllables.select(key, "word_idx", "syl_idx", F.posexplode("s").alias("phone_idx", "phone"))


def unstress(phone: Column) -> Column:
    return F.regexp_replace(phone, "[012]$", "")


def split_affricates(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("CH"), F.lit("T_SH")), F.lit("JH"), F.lit("D_ZH"))


def stress_bits(phone_array: Column) -> Column:
    """For each vowel 1 if its digit is 1, else 0."""
    return F.transform(F.filter(phone_array, lambda p: p.rlike("[012]$")), lambda p: p.endswith("1").cast("int"))


def collapse_runs(arr: Column) -> Column:
    """Consecutive equal elements once."""
    return F.filter(arr, lambda x, i: (i == 0) | (x != F.get(arr, F.greatest(i - 1, F.lit(0)))))


def map_phones(phone_array: Column, mapping: dict[str, str]) -> Column:
    """Phones replaced by a mapping; others stay."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(phone_array, lambda p: F.coalesce(F.try_element_at(known, p), p))


def normalize_ending(word: Column, phone_array: Column) -> Column:
    """A last ``AH0 D`` of words in -ed, and ``AH0 Z`` of words in -es, becomes ``IH0 D`` or ``IH0 Z``."""
    n = F.size(phone_array)
    last = F.array_join(F.slice(phone_array, F.greatest(n - 1, F.lit(1)), F.lit(2)), "_")
    hit = (word.endswith("ed") & (last == "AH0_D")) | (word.endswith("es") & (last == "AH0_Z"))
    return F.when(hit, F.concat(F.slice(phone_array, F.lit(1), n - 2), F.array(F.lit("IH0"), F.element_at(phone_array, -1)))).otherwise(phone_array)


def stress_pattern(phone_array: Column) -> tuple[Column, Column]:
    """Number of vowels and the 1-based place of the first primary stress among them (0: none)."""
    bits = stress_bits(phone_array)
    return F.size(bits), F.array_position(bits, 1)


def format_phonetics(syllables: Column) -> Column:
    """Syllables of phones back to text."""
    return F.array_join(F.transform(syllables, lambda s: F.array_join(s, "_")), "|")


def one_insertion(short: Column, long: Column) -> Column:
    """The 0-based index at which one element of ``long`` must go to give ``short``; null if there is none."""
    where = F.filter(
        F.sequence(F.lit(0), F.size(long) - 1),
        lambda i: F.concat(F.slice(long, F.lit(1), i), F.slice(long, i + 2, F.greatest(F.size(long) - i - 1, F.lit(0)))) == short,
    )
    return F.when(F.size(long) == F.size(short) + 1, F.try_element_at(where, F.lit(1)))


def rle(arr: Column) -> Column:
    """Runs of equal elements as ``value, n``."""
    starts = F.filter(F.sequence(F.lit(0), F.size(arr) - 1), lambda i: (i == 0) | (F.get(arr, i) != F.get(arr, F.greatest(i - 1, F.lit(0)))))
    runs = F.transform(starts, lambda s, k: F.struct(F.get(arr, s).alias("value"), (F.coalesce(F.get(starts, k + 1), F.size(arr)) - s).alias("n")))
    return F.when(F.size(arr) > 0, runs).otherwise(F.filter(runs, lambda x: F.lit(False)))


def add_stress(syllables: Column, stressed: Column, expected: Column, vowels: list[str]) -> Column:
    """Syllables of phones with 1 on vowels of the stressed syllable and 0 on others, if their number is the expected one."""
    known = F.array(*map(F.lit, vowels))

    def syllable(s: Column, i: Column) -> Column:
        mark = F.when(F.coalesce(i == stressed, F.lit(False)), "1").otherwise("0")
        return F.transform(s, lambda p: F.when(F.array_contains(known, p), F.concat(p, mark)).otherwise(p))

    return F.when(F.size(syllables) == expected, F.transform(syllables, syllable)).otherwise(syllables)


def stressed_syllable(syllables: Column, sign: str = "ˈ") -> Column:
    """Index of the first syllable of phones that holds the stress sign; null without one."""
    return F.nullif(F.array_position(F.transform(syllables, lambda s: F.exists(s, lambda p: p.contains(sign))), True) - 1, F.lit(-1))


def substitute_basis(syllables: Column, index: Column, n_target: Column, basis: Column, position: str) -> Column:
    """``phones, truth``: a word whose target syllable has its last (``end``) or first (``start``) phones replaced by the basis.

    syllables: of the word; index: of the target syllable; n_target: phones of the target; basis: an array of phones.
    truth: the phones of the target and the one beside it, as they were, without stress.
    """
    own = F.get(syllables, index)
    keep = F.greatest(F.size(own) - n_target, F.lit(0))
    changed = F.concat(F.slice(own, F.lit(1), keep), basis) if position == "end" else F.concat(basis, F.slice(own, n_target + 1, keep))
    phones = F.flatten(F.transform(syllables, lambda s, i: F.when(i == index, changed).otherwise(s)))
    n = F.least(n_target + 1, F.size(own))
    truth = F.slice(own, F.size(own) - n + 1 if position == "end" else F.lit(1), n)
    return F.struct(phones.alias("phones"), F.transform(truth, unstress).alias("truth"))


def glide_schwa_alternatives(word: Column) -> Column:
    """Forms of a formatted word whose glide and schwa (``ɪ|ə``, ``i|ə``) may be one syllable: merged first, then as given.

    A schwa merged with its glide carries no stress digit; a word without such a pair has one form.
    """
    merged = F.regexp_replace(F.regexp_replace(word, r"(ɪ|i)([012]?)\|ə", "$1$2_ə"), r"(ɪ|i)([012])_ə[012]", "$1$2_ə")
    return F.when(merged == word, F.array(word)).otherwise(F.array(merged, word))


def target_error(phonetics: Column, target: Column, word: Column, syllable: Column, alphabet: list[str], occurrence: Column | None = None) -> Column:
    """What is wrong with a target: the first of five errors, or null.

    The target's phones are checked first, then the indexes of its word and syllable (both from 0), then whether it is
    in that syllable, and, for a target of one phone, whether it is there more than ``occurrence`` times.
    """
    words = split_phonetics(phonetics)
    own = F.get(F.get(words, word), syllable)
    bad = invalid_phone(F.split(target, "_"), alphabet)
    times = F.size(F.filter(own, lambda p: p == target))
    out = F.when(bad.isNotNull(), F.concat(F.lit("target phone "), bad, F.lit(" is not a phoneme")))
    out = out.when(word >= F.size(words), "word_idx >= n of words").when(syllable >= F.size(F.get(words, word)), "syl_idx >= n of syllables")
    out = out.when(~F.array_join(own, "_").contains(target), "target not in syllable")
    return out if occurrence is None else out.when(occurrence >= times, "target_occurence_idx >= n of ocurrences in syllable")


# Phones by category, in three alphabets. Vowels of the first carry a stress digit.
CATEGORIES = {
    "approximant": ["L", "R", "W", "Y"],
    "nasal": ["M", "N", "NG"],
    "fricative": ["DH", "F", "HH", "S", "SH", "TH", "V", "Z", "ZH"],
    "affricate": ["CH", "JH"],
    "stop": ["B", "D", "G", "K", "P", "T"],
}
LETTERS = {
    "vowel": list("aeiouyàáâäæãåāèéêëēėęîïíīįìôöòóœøōõûüùúūůÿ"),
    "nasal": list("lmnrw"),
    "fricative": list("zvsfh"),
    "stop": list("bcdgtkpqxhj"),
}
IPA = {
    "vowel": [*LETTERS["vowel"], *"ɝəaɔʌãeéẽɛøoõiu"],
    "nasal": list("lmnrw"),
    "fricative": list("zvsfhʃ"),
    "stop": list("bcdgtkpqxhj"),
}
MFA_IPA = {
    "vowel": [*IPA["vowel"], "ɐ", "ɑ", "ɑː", "ɑ̃", "ɒ", "ɒː", "ɚ", "ɜ", "ɜː", "ʉ", "ʉː", "ʊ", "ɪ", "ɫ̩", "m̩", "n̩", "ᵻ", "aʊ", "aɪ", "eɪ", "oʊ", "əʊ", "ɔɪ"],
    "approximant": ["ɹ", "ɥ", "ɫ", "w", "j"],
    "nasal": [*"lmnr", "ɱ", "ɲ", "ŋ", "ʎ"],
    "fricative": [*"zvsfhʃ", "ʒ", "ʝ", "β", "θ", "ç", "ð", "ɣ", "ʁ"],
    "affricate": ["ɟʝ"],
    "stop": [*"bcdgtkpqxh", "ʔ", "ɡ", "ɟ", "ɾ", "ɾʲ"],
}
ALPHABETS = {"letters": LETTERS, "IPA": IPA, "MFA_IPA": MFA_IPA}


def category(phone: Column, mode: str = "CMU") -> Column:
    """The category of a phone; null if it has none. CMU phones are vowels by their stress digit.

    In the other modes a symbol that is not listed itself has the category of its first character.
    """
    if mode == "CMU":
        out = F.when(phone.rlike("[012]$"), "vowel")
        for name, members in CATEGORIES.items():
            out = out.when(phone.isin(members), name)
        return out
    low, out = F.lower(phone), None
    table = F.create_map(*[F.lit(x) for p, c in {p: c for c, ps in reversed(ALPHABETS[mode].items()) for p in ps}.items() for x in (p, c)])
    first = F.try_element_at(table, F.substring(low, 1, 1))
    return F.when(first == "vowel", first).otherwise(F.coalesce(F.try_element_at(table, low), first))


def phone_categories(spark: SparkSession, mode: str) -> DataFrame:
    """``phone, category`` of the listed phones of a mode; the first category that lists a phone holds."""
    listed = CATEGORIES if mode == "CMU" else ALPHABETS[mode]
    rows = {p: c for c, ps in reversed(listed.items()) for p in ps}
    return spark.createDataFrame(sorted(rows.items()), "phone string, category string")


def invalid_phone(phone_array: Column, alphabet: list[str]) -> Column:
    """The first phone, without stress, that is not in the alphabet; null if all are."""
    known = F.array(*map(F.lit, alphabet))
    return F.get(F.filter(F.transform(phone_array, unstress), lambda p: ~F.array_contains(known, p)), F.lit(0))


def phone_ids(inventory: DataFrame) -> DataFrame:
    """``phone, id, code``: ids from 0 in alphabetical order and one-character codes; an alphabet is small."""
    order = F.row_number().over(Window.orderBy("phone")) - 1
    ids = inventory.select("phone", order.cast("long").alias("id"))
    return ids.withColumn("code", F.char(F.col("id") + 33))


def alphabet_ids(alphabet: DataFrame, silence: str = "[SIL]") -> DataFrame:
    """``phone, id``: ids from 0 in alphabetical order, silence last; read the other way it gives phones of ids."""
    order = F.row_number().over(Window.orderBy(F.col("phone") == silence, "phone")) - 1
    return alphabet.select("phone").distinct().select("phone", order.cast("long").alias("id"))


def clusters(phones: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """``keys, onset, coda``: phones of a syllable before and after its vowel, joined by ``_``."""
    seen = F.sum(F.col("phone").rlike("[012]$").cast("int")).over(Window.partitionBy(*keys).orderBy(order))
    side = phones.withColumn("v", seen).where(~F.col("phone").rlike("[012]$"))

    def joined(before: bool) -> Column:
        picked = F.collect_list(F.when((F.col("v") == 0) if before else (F.col("v") > 0), F.struct(order, "phone")))
        return F.array_join(F.transform(F.array_sort(picked), lambda x: x["phone"]), "_")

    return side.groupBy(*keys).agg(joined(True).alias("onset"), joined(False).alias("coda"))


def token_distance(a: Column, b: Column, alphabet: list[str]) -> Column:
    """Edit distance of two phone arrays over an alphabet, by one character for each phone."""
    known = F.array(*map(F.lit, alphabet))

    def coded(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda p: F.char(F.array_position(known, p) + 33)), "")

    return F.levenshtein(coded(a), coded(b))
