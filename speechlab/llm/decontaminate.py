"""Benchmark decontamination by a prefix-filtered join, with DataFrame functions only.

Items and documents are split into words; a window is ``size`` consecutive item words, and an
item of fewer words, but not none, is one window. Words are ordered by rarity, their counts in
all documents (then by the word); as a window must be contained whole, its necessary prefix
is one token, its rarest word. Documents are joined on these prefix tokens only. A match at a
place fixes where the window would start (the positional bound) and must leave enough words
before and after (the length bound); then the window-sized run of words is compared exactly.
A document is dealt with in pieces of ``PIECE`` words that overlap by a window, so a row carries
the words around a match and nothing is joined back to whole texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Join keys are fully
lower-cased words (equal words have equal keys); the exact comparison is made on the words.

Defined results: null or empty text has no words and is not contaminated; rows that repeat a
document id and text share a result; an item repeated under several ids counts for each; an
item without words or id, or an empty benchmark, occurs nowhere. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.llm._common import ascii_lower, free_name, join_counted, stored

WINDOW = 10
#: Words of a document that travel with each match of a piece.
PIECE = 48
#: Windows or words that are broadcast at most; beyond it the join shuffles.
BROADCAST = 200_000
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text):
    """The words of a text in their own case (lower-casing A-Z neither makes nor breaks one)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def windows_of(items: DataFrame, size: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item, at, words``: every window of every item, in lower case (A-Z)."""
    words = items.select(F.col(key).alias("item"), words_of(ascii_lower(F.col(text))).alias("ws")).where(F.size("ws") > 0).distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0)))
    return words.select("item", F.explode(starts).alias("at"), "ws").select("item", "at", F.slice("ws", F.col("at") + 1, size).alias("words"))


def pieces_of(docs: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``d, t, p, before, ws``: pieces from word ``p`` on, with up to ``size - 1`` words before and after."""
    words = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), words_of(F.col(text)).alias("all"))
    starts = F.when(F.size("all") > 0, F.sequence(F.lit(0), F.size("all") - 1, F.lit(PIECE)))
    cut = F.transform(
        starts,
        lambda p: F.struct(
            p.alias("p"),
            F.least(p, F.lit(size - 1)).alias("before"),
            F.slice(F.col("all"), F.greatest(p - (size - 1), F.lit(0)) + 1, F.lit(PIECE + size - 1) + F.least(p, F.lit(size - 1))).alias("ws"),
        ),
    )
    return words.select("d", "t", F.explode(cut).alias("x")).select("d", "t", "x.p", "x.before", "x.ws")


def word_counts(docs: DataFrame, words: DataFrame, text: str = "text", most: int = BROADCAST) -> DataFrame:
    """``word, n``: how often each of ``words`` stands in all documents."""
    every = docs.select(F.explode(F.split(text, _SPLIT)).alias("raw")).select(F.lower("raw").alias("word"))
    if words.limit(most + 1).count() <= most:
        return every.join(F.broadcast(words), "word").groupBy("word").agg(F.count("*").alias("n"))
    return every.groupBy("word").agg(F.count("*").alias("n")).join(words, "word", "left_semi")  # counted before it is shuffled


def _hits(pieces: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """``d, t, p, before, j, o, words, items, ws``: pieces beside the windows whose prefix token stands at their word ``j``.

    Up to ``most`` tokens are broadcast. Beyond that the words alone are shuffled, without the words around them
    (places of very frequent ones stay where they are), and pieces come back to the places that matched.
    """
    own = F.slice("ws", F.col("before") + 1, PIECE)
    if tokens.limit(most + 1).count() <= most:
        placed = pieces.select("d", "t", "p", "before", "ws", F.posexplode(own).alias("j", "raw"))
        return placed.withColumn("word", F.lower("raw")).join(F.broadcast(tokens), "word")
    placed = pieces.select("d", "t", "p", "before", F.size("ws").alias("size"), F.posexplode(own).alias("j", "raw"))
    placed = placed.withColumn("word", F.lower("raw")).drop("raw")
    start = F.col("before") + F.col("j") - F.col("o")
    fits = (start >= 0) & (start + F.size("words") <= F.col("size"))
    found = join_counted(placed, tokens, ["word"]).where(fits).drop("word", "size", "n").dropDuplicates(["d", "t", "p", "j", "o", "words"])
    texts = pieces.select(F.col("d").alias("d0"), F.col("t").alias("t0"), F.col("p").alias("p0"), "ws").dropDuplicates(["d0", "t0", "p0"])
    same = F.col("d").eqNullSafe(F.col("d0")) & (F.col("t") == F.col("t0")) & (F.col("p") == F.col("p0"))
    return found.join(texts, same).drop("d0", "t0", "p0")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id", most: int = BROADCAST) -> DataFrame:
    """``d, t, first, last, items``: exact occurrences of windows in documents (bounds in words, the last included)."""
    windows = stored(windows_of(items, size).select("item", "words").where("item is not null").distinct(), "windows")
    vocabulary = windows.select(F.explode("words").alias("word")).select(F.lower("word").alias("word")).distinct()
    counts = stored(word_counts(docs, vocabulary, text, most), "counts")
    ranked = windows.select("item", "words", F.posexplode("words").alias("o", "word")).withColumn("word", F.lower("word"))
    ranked = ranked.join(counts, "word")  # a window with a word that no document has occurs nowhere
    rarest = F.min(F.struct("n", "word", "o")).alias("r")
    prefixes = ranked.groupBy("item", "words").agg(rarest, F.count("*").alias("found")).where(F.col("found") == F.size("words"))
    whole = prefixes.select(F.col("r.word").alias("word"), F.col("r.n").alias("n"), F.col("r.o").alias("o"), "words", "item")
    tokens = stored(whole.groupBy("word", "n", "o", "words").agg(F.sort_array(F.collect_set("item")).alias("items")), "prefixes")
    hits = _hits(pieces_of(docs, size, text, key), tokens, most)
    start = F.col("before") + F.col("j") - F.col("o")  # in the piece, from 0
    n = F.size("words")
    fits = (start >= 0) & (start + n <= F.size("ws"))
    same = F.transform(F.slice("ws", F.greatest(start, F.lit(0)) + 1, n), lambda w: ascii_lower(w)) == F.col("words")
    first = F.col("p") + F.col("j") - F.col("o")
    return hits.where(fits).where(same).select("d", "t", first.alias("first"), (first + n - 1).alias("last"), "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id", most: int = BROADCAST) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` for every row of ``docs``."""
    found = occurrences(docs, items, size, text, key, most)
    per = found.groupBy("d", "t").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["last"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"] - 1))).alias("n"),
        ),
        lambda a: a["n"],
    )
    per = per.select("d", "t", covered.cast("long").alias("n_hit"), F.array_sort(F.transform("ids", lambda i: i.cast("string"))).alias("item_ids"))
    counted = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("t0"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    out = counted.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t0") == F.col("t")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    own, bad_id, bad_hash = (free_name(docs.columns, n) for n in ("__t", "__bad", "__bad_t"))
    bad = occurrences(docs, items, size, text, key).select(F.col("d").alias(bad_id), F.col("t").alias(bad_hash)).distinct()
    marked = docs.withColumn(own, F.xxhash64(text))
    kept = marked.join(bad, F.col(key).eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_hash)), "left_anti")
    return kept.drop(own)
