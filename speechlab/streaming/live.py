"""The same phrase and gate reports on a live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(words: DataFrame, gap: float, delay: str) -> DataFrame:
    """``file_id, text, start, end, n_words``: phrases of each file's words, as ``windows.sessionize`` gives them for a whole table.

    words: ``file_id, word_id, word, start, end`` (seconds) and the event time ``ts`` of ``start``. A word's session lasts
    for its own duration and ``gap`` seconds more, so a silence over ``gap`` starts a new phrase whatever a word's length; words of a
    phrase are held as state and told in the order of their starts. Append mode: a phrase comes once the watermark
    (``delay``) has passed its end, and words that are late by less than the delay are in their place.
    """
    micros = F.round((F.col("end") - F.col("start") + F.lit(gap)) * 1_000_000).cast("long") + 1  # a silence of just the gap goes on
    seen = words.withWatermark("ts", delay)
    phrases = seen.groupBy("file_id", F.session_window("ts", F.concat(micros.cast("string"), F.lit(" microseconds"))).alias("w")).agg(
        F.sort_array(F.collect_list(F.struct("start", "word_id", "word"))).alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words")
    )
    return phrases.select("file_id", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"), "start", "end", "n_words")


def stream_gate_counts(rows: DataFrame, width: str, delay: str) -> DataFrame:
    """Rows of each status in tumbling windows."""
    seen = rows.withWatermark("ts", delay)
    return seen.groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
