"""Text normalisation as column expressions over a text table."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations and their expansions, in the case given.
ABBREVIATIONS = {"mr": "mister", "mrs": "misses", "dr": "docteur", "Mr": "Mister", "Mrs": "Misses", "Dr": "Docteur", "etc": "etcetera"}
# Letters with accents and what they fold to.
ACCENTED = "àáâäãåçèéêëìíîïñòóôöõùúûüÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuy"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def normalize_text(text: Column, lower: bool = True, chars: str = r'[,?.!¡;:"*{}]') -> Column:
    """Strip marks, turn curly quotes straight, lower if asked, squeeze spaces."""
    out = F.regexp_replace(F.replace(text, F.lit("’"), F.lit("'")), chars, "")
    return F.trim(F.regexp_replace(F.lower(out) if lower else out, " +", " "))


def chunks(text: Column) -> Column:
    """Breath groups: parts between marks, empty ones dropped."""
    return F.filter(F.split(text, "[,;.!¡?:/]"), lambda c: c != "")


def chunk_word_counts(text: Column) -> Column:
    """Words of each breath group; one of blanks counts 0."""
    return F.transform(chunks(text), lambda c: F.size(_words(c)))


def glue_punctuation(text: Column) -> Column:
    """Remove the space before a glued mark."""
    return F.regexp_replace(text, r" ([,?.!;:{}…])", "$1")


def expand_abbreviations(text: Column, table: dict[str, str] | None = None) -> Column:
    """Words that equal an abbreviation, expanded; others stay."""
    return F.array_join(expand_words(F.split(text, " "), table), " ")


def expand_words(words: Column, table: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (ABBREVIATIONS if table is None else table).items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))


def is_acronym(word: Column) -> Column:
    """Fully in upper case (and having a case at all)."""
    return (F.upper(word) == word) & (F.lower(word) != word)


def acronyms(text: Column) -> Column:
    """Words fully in upper case."""
    return F.filter(_words(text), is_acronym)


def acronym_indexes(words: Column) -> Column:
    """Places, from 0, of the acronyms among words."""
    return F.filter(F.transform(words, lambda w, i: F.when(is_acronym(w), i)), lambda i: i.isNotNull())


def spell_acronyms(words: Column) -> Column:
    """Words in lower case, the letters of acronyms joined by hyphens."""
    spelled = F.transform(words, lambda w: F.when(is_acronym(w), F.regexp_replace(w, "(?s)(?<=.)(?=.)", "-")).otherwise(w))
    return F.transform(spelled, F.lower)


def acronym_compound(words: Column, indexes: Column, always: bool = False) -> Column:
    """Acronyms with hyphens as ``{a b c}``, others without braces; always: braces for any of more than one character."""

    def one(w: Column, i: Column) -> Column:
        braced = F.concat(F.lit("{"), F.replace(w, F.lit("-"), F.lit(" ")), F.lit("}"))
        test = F.length(w) > 1 if always else w.contains("-")
        return F.when(F.array_contains(indexes, i), F.when(test, braced).otherwise(F.translate(w, "{}", ""))).otherwise(w)

    return F.transform(words, one)


def brace_groups(tokens: Column, expanded: Column) -> Column:
    """``norm, source`` arrays: expansions of several words in braces, and the tokens they come from as well."""

    def braced(x: Column) -> Column:
        return F.concat(F.lit("{"), x, F.lit("}"))

    norm = F.transform(expanded, lambda e: F.when(e.contains(" "), braced(e)).otherwise(e))
    source = F.zip_with(tokens, expanded, lambda t, e: F.when(e.contains(" "), braced(t)).otherwise(t))
    return F.struct(norm.alias("norm"), source.alias("source"))


#: Marks that may be glued to words.
MARKS = ',?.!¡;:"{}*…'


def edge_maps(words: Column, marks: str = MARKS) -> Column:
    """``before, after``: maps from a word's place to the marks glued to its start and to its end; words of marks only have both."""
    inside = f"[{''.join(chr(92) + c for c in marks)}]+"

    def found(pattern: str) -> Column:
        return F.map_from_entries(
            F.filter(F.transform(words, lambda w, i: F.struct(i.alias("key"), F.regexp_extract(w, pattern, 0).alias("value"))), lambda x: x["value"] != "")
        )

    return F.struct(found(f"^{inside}").alias("before"), found(f"{inside}$").alias("after"))


def strip_marks(words: Column, marks: str = MARKS) -> Column:
    """Words without any of the marks; curly quotes become straight."""
    return F.transform(words, lambda w: F.translate(F.replace(w, F.lit("’"), F.lit("'")), marks, ""))


def reattach(words: Column, before: Column, after: Column) -> Column:
    """Marks of ``edge_maps`` back on their words."""
    none = F.lit("")
    return F.transform(words, lambda w, i: F.concat(F.coalesce(F.try_element_at(before, i), none), w, F.coalesce(F.try_element_at(after, i), none)))


def restore_case(segmented: Column, cased: Column, separator: str = "|") -> Column:
    """Words in their own case with the separators of ``segmented`` after the same letters (arrays of words)."""

    def one(s: Column, w: Column) -> Column:
        lengths = F.transform(F.split(s, rf"\Q{separator}\E"), F.length)
        starts = F.transform(lengths, lambda n, k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, x: a + x))
        parts = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda k: F.when(k == F.size(lengths) - 1, F.substring(w, F.get(starts, k) + 1, F.length(w))).otherwise(F.substring(w, F.get(starts, k) + 1, F.get(lengths, k))))
        return F.array_join(parts, separator)

    return F.zip_with(segmented, cased, one)


def rewrite_utterance_line(line: Column, number: bool = False) -> Column:
    """The second hyphen becomes a comma, each ``,0`` with its zeros ``-0``, and ``.wav`` goes before the first comma.

    number: also a comma after the last number, first of all.
    """
    out = F.regexp_replace(line, r"^(.*[0-9])([^0-9]*)$", "$1,$2") if number else line
    out = F.regexp_replace(out, "^([^-]*-[^-]*)-", "$1,")
    out = F.regexp_replace(out, ",0+", "-0")
    return F.regexp_replace(out, "^([^,]*),", "$1.wav,")


def ungroup(text: Column) -> Column:
    """Hyphens to spaces, braces removed."""
    return F.translate(text, "-{}", " ")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, FOLDED)


def end_with_period(text: Column) -> Column:
    return F.concat(F.trim(text), F.lit("."))


def edge_marks(text: Column) -> Column:
    """Words with leading or trailing marks, each as ``index:before|after``."""
    every = F.transform(
        _words(text),
        lambda w, i: F.concat(i.cast("string"), F.lit(":"), F.regexp_extract(w, r"^[,?.!;:]*", 0), F.lit("|"), F.regexp_extract(w, r"[,?.!;:]*$", 0)),
    )
    return F.filter(every, lambda x: ~x.endswith(":|"))


def focus_bins(text: Column) -> Column:
    """1 for each word that holds a star, else 0."""
    return F.transform(_words(text), lambda w: w.contains("*").cast("int"))


def first_focus(text: Column) -> Column:
    """Place, from 0, of the first starred word; null without one."""
    return F.nullif(F.array_position(focus_bins(text), 1) - 1, F.lit(-1))


@lru_cache(maxsize=1)
def _digits() -> str:
    """Ranges of a pattern for all characters that are digits in any script, raised and circled ones included."""
    found = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit()]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


def clean_letters(text: Column) -> Column:
    """Without digits (of any script) and marks."""
    return F.regexp_replace(text, rf"[{_digits()}!-/:-@\[-`{{-~»«˃˂〈〉♦•—¿·]", "")


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words without an apostrophe."""
    return df.select(F.explode(_words(F.col(text))).alias("word")).where(~F.col("word").contains("'")).distinct()
