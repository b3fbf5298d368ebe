"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines are what ``\\n`` separates; a line of blanks only has no words and belongs to no run. A run
that two places share is deleted at the later one, extended to its maximum both ways: a line goes if
any run over it of at least ``min_words`` words also stands at an earlier place, whichever that is.

1. Winnowing: from each line on, the shortest run with ``min_words`` words is a window; its smallest
   line hash (the last of equals) is selected. Only selected places are kept, a few for each window's
   length of text. Any shared run holds a whole window, whose selection depends on its own lines only,
   so both places select the same line: shared runs have a common fingerprint for certain.
2. Join of positions: fingerprints that stand at one place only match nothing and go, and with them
   most of the text. Their places are joined by counts, not in pairs.
3. Extension: around each place left, runs are grown line by line to both sides over the fingerprint
   until they have ``min_words`` words: from each earlier line on, and up to each later line. A grown
   run is matched by its fingerprint and the hash of its lines; the earliest place of each (by document
   id, then hash of the text, then line) stays. Any line of a maximal shared run lies in a run grown
   over one of its fingerprints (what follows the last whole window has fewer than ``min_words`` words),
   so the grown runs of later places together are the maximal ones, and their lines go.

No pair of places is made: a passage in a third of all documents is a partial minimum for each task,
and places of very frequent runs are not shuffled (``join_counted``).

Defined results (``drop_repeated_runs``): a line goes if and only if it is in a run, repeated at
an earlier place in the same document or another, that has ``min_words`` words; so do lines of
blanks inside such a run. Places may overlap. ``drop_repeated_lines`` is the narrower rule of the
windows from each line on: there up to ``min_words - 1`` words at the end of a repeated run stay.
Null text stays null and empty text empty; rows that repeat a document id and text are one document
and share its fate (they do not delete each other); a null id comes first. A run of fewer words is
kept. Extra columns are passed on; where one has the name of an added column (``lines``,
``lines_deleted``), the added one gets underscores at its end; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlab.llm._common import free_name, join_counted, stored

#: Words that a repeated run of lines has at least.
MIN_WORDS = 50


def line_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``d, t, i, h, w``: document id, hash of the text, line number, hash of the line, its words; lines with words only."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    words = F.regexp_count("line", F.lit(r"[^ \t\x0B\f\r]+"))
    lines = lines.where(F.col("line").rlike(r"[^ \t\x0B\f\r]"))
    return lines.select("d", "t", "i", F.xxhash64("line").alias("h"), words.cast("long").alias("w"))


_OF = ("d", "t")


def _placed(lines: DataFrame) -> DataFrame:
    """``lines`` of whole documents in one partition each, with the words ``before`` each line."""
    of = Window.partitionBy(*_OF).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("before", F.coalesce(F.sum("w").over(of), F.lit(0)).cast("long"))


def _ahead(min_words: int):
    return Window.partitionBy(*_OF).orderBy("before").rangeBetween(Window.currentRow, min_words - 1)


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``d, t, i, h``: the places that some window selects, each once; ``lines``: as ``line_table``, each line once."""
    ahead = _ahead(min_words)
    low = F.min(F.struct("h", (-F.col("i")).alias("i"))).over(ahead)
    chosen = _placed(lines).select(*_OF, low.alias("low"), F.sum("w").over(ahead).alias("words")).where(F.col("words") >= min_words)
    return chosen.select(*_OF, (-F.col("low.i")).alias("i"), F.col("low.h").alias("h")).distinct()


def grown_runs(lines: DataFrame, shared: DataFrame, min_words: int = MIN_WORDS, whole: bool = True) -> DataFrame:
    """``d, t, first, last, low, run``: runs grown over the places ``shared`` (d, t, i), their fingerprint and the hash of their lines.

    whole: not only from each line on, but also up to each line, and over the blanks between two lines of ``min_words`` words.
    """
    marks = shared.select(*_OF, "i", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("w"), F.lit(True).alias("mark"))
    both = lines.select(*_OF, "i", "h", "w", F.lit(False).alias("mark")).union(marks).repartition(*_OF)
    rows = both.groupBy(*_OF, "i").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.max("mark").alias("mark"))
    rows = rows.withColumn("any", F.max("mark").over(Window.partitionBy(*_OF))).where("any").drop("any")  # other documents share nothing
    of, ahead = Window.partitionBy(*_OF), _ahead(min_words)

    def run(first, last, low, hashes):
        return F.struct(first.alias("first"), last.alias("last"), low.alias("low"), F.xxhash64(hashes, F.size(hashes)).alias("run"))

    rows = _placed(rows).select(
        *_OF, "i", "h", "w", "before", (F.col("before") + F.col("w")).alias("end"),
        F.min(F.struct("h", (-F.col("i")).alias("i"), "mark")).over(ahead).alias("least"),
        F.max("i").over(ahead).alias("last"),
        F.sum("w").over(ahead).alias("words"),
        F.collect_list("h").over(ahead).alias("lines"),
        *([F.lead(c).over(of.orderBy("before")).alias(f"{c}_next") for c in "ihw"] if whole else []),
    )
    rows = rows.withColumn("low", F.when((F.col("words") >= min_words) & F.col("least.mark"), F.col("least.h")))
    found = [F.when(F.col("low").isNotNull(), run(F.col("i"), F.col("last"), F.col("low"), F.col("lines")))]
    if whole:
        back = of.orderBy("end").rangeBetween(1 - min_words, Window.currentRow)
        rows = rows.select(
            "*",
            F.min(F.struct("i", "low")).over(back).alias("start"),
            F.sum("w").over(back).alias("back_words"),
            F.collect_list("h").over(back).alias("back_lines"),
        )
        # without its last line it would still be long enough: it is no run from its first line on
        longer = F.col("start.low").isNotNull() & (F.col("back_words") - F.col("w") >= min_words)
        found.append(F.when(longer, run(F.col("start.i"), F.col("i"), F.col("start.low"), F.col("back_lines"))))
        pair = F.col("low").isNotNull() & (F.col("w") >= min_words) & (F.col("w_next") >= min_words)
        found.append(F.when(pair, run(F.col("i"), F.col("i_next"), F.col("low"), F.array("h", "h_next"))))
    return rows.select(*_OF, F.inline(F.array_compact(F.array(*found))))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """``d, t, runs``: for each document with later repeated runs the bounds of their grown runs, in order."""
    lines = stored(line_table(docs, text, key).repartition(*_OF).dropDuplicates([*_OF, "i"]), "lines")
    places = stored(fingerprints(lines.repartition(*_OF), min_words), "fingerprints")
    counts = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = join_counted(places, counts, ["h"]).select(*_OF, "i")
    prints = stored(grown_runs(lines, shared, min_words, whole), "runs")
    place = F.struct(*_OF, "first")
    # partial minima come before the shuffle, so a passage in a third of all documents is a row for each task
    firsts = prints.groupBy("low", "run").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1")
    later = join_counted(prints, stored(firsts, "firsts"), ["low", "run"]).where(place > F.col("place"))
    return later.groupBy(*_OF).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with later repeated runs of lines, extended both ways, deleted from ``text``, plus ``lines_deleted`` and ``lines``."""
    return _without(docs, repeated_lines(docs, min_words, text, key, whole=True), text, key)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same for the windows from each line on alone: the end of a repeated run may stay."""
    return _without(docs, repeated_lines(docs, min_words, text, key), text, key)


def _without(docs: DataFrame, runs: DataFrame, text: str, key: str) -> DataFrame:
    names = docs.columns
    own, whole, rest = (free_name(names, n) for n in ("__t", "__lines", "__kept"))
    marked = docs.withColumn(own, F.xxhash64(text)).alias("x")
    joined = marked.join(runs.alias("r"), F.col(f"x.{key}").eqNullSafe(F.col("r.d")) & (F.col(f"x.{own}") == F.col("r.t")), "left")
    lines = F.split(F.col(f"x.{text}"), "\n")
    spans = F.col("r.runs")
    # the windows come in order of their first and last lines: one walk keeps the lines before, between and after them
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("kept"))
    walk = F.aggregate(
        spans,
        start,
        lambda a, x: F.struct(
            F.greatest(a["next"], x["last"] + 1).alias("next"),
            F.when(x["first"] > a["next"], F.concat(a["kept"], F.slice(F.col(whole), a["next"] + 1, F.greatest(x["first"] - a["next"], F.lit(0))))).otherwise(a["kept"]).alias("kept"),
        ),
        lambda a: F.concat(a["kept"], F.slice(F.col(whole), a["next"] + 1, F.greatest(F.size(F.col(whole)) - a["next"], F.lit(0)))),
    )
    with_lines = joined.withColumn(whole, lines)
    kept = F.when(spans.isNull(), F.col(whole)).otherwise(walk)
    out = with_lines.withColumn(rest, kept)
    size = F.coalesce(F.size(whole), F.lit(0)).cast("long")
    left = F.coalesce(F.size(rest), F.lit(0)).cast("long")
    columns = [F.when(spans.isNull(), F.col(f"x.{c}")).otherwise(F.array_join(rest, "\n")).alias(c) if c == text else F.col(f"x.{c}").alias(c) for c in names]
    counts = (F.greatest(size, F.lit(0)), F.greatest(size - left, F.lit(0)))
    return out.select(*columns, *[c.alias(free_name(names, n)) for c, n in zip(counts, ("lines", "lines_deleted"))])
