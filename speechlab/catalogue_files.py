"""Queries that write files derived from the tables and read them with the library's readers, and live feeds over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlab.plans.registry import add
from speechlab.plans.scratch import folder
from speechlab.sources import files as S
from speechlab.streaming import live


def _lines(df: DataFrame, line) -> str:
    """A folder of text files with one line for each row."""
    path = folder(df.sparkSession)
    df.select(line.alias("value")).write.text(path)
    return path


def _long(col: str):
    return F.col(col).cast("long").alias(col)


@add("s1_corpus_metadata", "SELECT 'c' || c_custkey AS name, c_name || ' \"q\"' AS text, c_mktsegment AS normalized FROM customer", "customer")
def _(customer):
    path = _lines(customer, F.concat_ws("|", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat("c_name", F.lit(' "q"')), "c_mktsegment"))
    return S.read_corpus_metadata(customer.sparkSession, path)


@add("s2_tsv_by_language", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS id, CASE n_regionkey % 2 WHEN 0 THEN 'de' ELSE 'en' END AS lang FROM nation", "nation")
def _(nation):
    paths = {}
    for k, lang in ((0, "de"), (1, "en")):
        paths[lang] = folder(nation.sparkSession)
        nation.where(F.col("n_regionkey") % 2 == k).select(F.col("n_name").alias("name"), _long("n_nationkey").alias("id")).write.csv(paths[lang], sep="\t", header=True)
    return S.read_tsv(nation.sparkSession, paths, "name string, id long")


@add("s3_multi_delim", "SELECT 'e' || event_id || '|' || event_type || '|' || user_id || '|' || 'z' AS fields FROM events", "events")
def _(events):
    line = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(";"), "event_type", F.lit(","), F.col("user_id").cast("string"), F.lit("\tz"))
    return S.read_multi_delim(events.sparkSession, _lines(events, line)).select(F.array_join("fields", "|").alias("fields"))


@add("s4_segments", "SELECT 'u' || word_id AS utt, 'f' || file_id || '.wav' AS wav, round(start, 3) AS start, round(\"end\", 3) AS stop FROM fx_words", "fx_words")
def _(words):
    line = F.format_string("u%d f%d.wav %.6f %.6f", "word_id", "file_id", "start", "end")
    return S.read_segments(words.sparkSession, _lines(words, line)).select("utt", "wav", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@add("s5_read_lexicon", "SELECT 'xx' AS lang, word, CAST(alt_idx AS INT) AS alt_idx, phones FROM fx_lexicon", "fx_lexicon")
def _(lexicon):
    bad = lexicon.where("alt_idx = 0").select(F.concat("word", F.lit("[1]")).alias("word"), "alt_idx", "phones")
    rows = lexicon.unionByName(bad).repartition(1).sortWithinPartitions("word", "alt_idx")
    path = folder(lexicon.sparkSession)
    rows.select(F.concat("word", F.lit("\t"), F.replace("phones", F.lit("_"), F.lit(" "))).alias("value")).write.text(path)
    return S.read_lexicon(lexicon.sparkSession, path, "xx")


@add("s6_json_lexicon", "SELECT word, CAST(alt_idx AS INT) AS alt_idx, phones FROM fx_lexicon", "fx_lexicon")
def _(lexicon):
    alternatives = F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "phones"))), lambda x: F.split(x["phones"], "_"))
    rows = lexicon.groupBy("word").agg(alternatives.alias("a"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("word", "a"))), lambda e: F.struct(e["word"].alias("key"), e["a"].alias("value")))
    whole = rows.groupBy(F.pmod(F.xxhash64("word"), F.lit(7)).alias("part")).agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    path = folder(lexicon.sparkSession)
    whole.repartition(7, "part").write.partitionBy("part").text(path)  # one object for each file
    return S.read_json_lexicon(lexicon.sparkSession, f"{path}/*")


@add("s7_phone_cells", "SELECT 'k' || rec_id || '.wav' AS file, string_agg(label, ',' ORDER BY frame_idx) AS phones, round(sum(frame_idx * 0.5::DOUBLE), 3) AS starts, count(*) AS n FROM fx_frames GROUP BY rec_id", "fx_frames")
def _(frames):
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct(F.col("frame_idx").cast("string"), v)))
    cell = F.struct(entry(F.col("frame_idx") * 0.5).alias("start"), entry(F.col("frame_idx") * 0.5 + 0.5).alias("end"), entry(F.col("label").cast("string")).alias("phone"))
    rows = frames.groupBy("rec_id").agg(cell.alias("c")).select(F.to_json(F.create_map(F.concat(F.lit("k"), F.col("rec_id").cast("string"), F.lit(".wav")), "c")).alias("value"), "rec_id")
    path = folder(frames.sparkSession)
    rows.write.partitionBy("rec_id").text(path)
    out = S.read_phone_cells(frames.sparkSession, f"{path}/*")
    starts = F.aggregate("phones", F.lit(0.0), lambda a, x: a + x["start"])
    return out.select("file", F.array_join(F.transform("phones", lambda x: x["phone"]), ",").alias("phones"), F.round(starts, 3).alias("starts"), F.size("phones").cast("long").alias("n"))


@add("s9_read_tiers", """SELECT rec_id AS file, 'words' AS tier, frame_idx AS idx, round(frame_idx * 0.5::DOUBLE, 6) AS start, 'w"' || label AS mark FROM fx_frames WHERE label % 3 > 0 UNION ALL SELECT rec_id, 'phones', frame_idx, round(frame_idx * 0.5::DOUBLE, 6), CAST(label AS VARCHAR) FROM fx_frames WHERE label % 4 > 0""", "fx_frames")
def _(frames):
    def tier(k: int, name: str, mark) -> Column:
        each = F.format_string('        intervals [%d]:\n            xmin = %.6f \n            xmax = %.6f \n            text = "%s" \n', F.col("frame_idx") + 1, F.col("frame_idx") * 0.5, F.col("frame_idx") * 0.5 + 0.5, mark)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", each.alias("t")))), lambda x: x["t"]), "")
        return F.concat(F.lit(f'    item [{k}]:\n        class = "IntervalTier" \n        name = "{name}" \n        xmin = 0 \n        xmax = 9 \n        intervals: size = 50 \n'), body)

    word = F.when(F.col("label") % 3 > 0, F.concat(F.lit('w""'), F.col("label").cast("string"))).otherwise("")
    phone = F.when(F.col("label") % 4 > 0, F.col("label").cast("string")).otherwise("sil")
    head = F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0 \nxmax = 9 \ntiers? <exists> \nsize = 2 \nitem []: \n')
    rows = frames.groupBy("rec_id").agg(F.concat(head, tier(1, "words", word), tier(2, "phones", phone)).alias("value"))
    path = folder(frames.sparkSession)
    rows.write.partitionBy("rec_id").text(path)
    out = S.read_tiers(frames.sparkSession, f"{path}/*")
    return out.select(F.regexp_extract("file", "rec_id=([0-9]+)", 1).cast("long").alias("file"), "tier", "idx", F.round("start", 6).alias("start"), "mark")


@add("s10_read_counts", "SELECT word, count(*) AS n FROM fx_tokens GROUP BY 1", "fx_tokens")
def _(tokens):
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"))
    return S.read_counts(tokens.sparkSession, _lines(counts, F.concat("word", F.lit("\t"), F.col("n").cast("string"))))


@add("s11_write_results", "SELECT event_id, event_type, fmt FROM events, (VALUES ('parquet'), ('json'), ('csv')) AS f(fmt)", "events")
def _(events):
    rows, out = events.select("event_id", "event_type"), None
    for fmt in ("parquet", "json", "csv"):
        path = folder(events.sparkSession)
        S.write_results(rows, path, fmt)
        back = events.sparkSession.read.format(fmt).schema("event_id long, event_type string").load(path).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@add("s12_write_srt", "SELECT file_id, count(*) AS n_cues, count(*) * 4 AS n_lines FROM fx_words GROUP BY 1", "fx_words")
def _(words):
    path = folder(words.sparkSession)
    S.write_srt(words.withColumnRenamed("word", "text"), path, ["file_id"])
    lines = S.read_srt(words.sparkSession, path, "file_id long")
    return lines.groupBy("file_id").agg(F.count_if(F.col("line").contains(" --> ")).alias("n_cues"), F.count("*").alias("n_lines"))


@add("s13_materialize", "SELECT user_id, count(*) AS n FROM events GROUP BY 1", "events")
def _(events):
    path = folder(events.sparkSession)
    counts = events.groupBy("user_id").agg(F.count("*").alias("n"))
    S.materialize(counts, path)
    return S.materialize(counts.limit(0), path, "ignore")  # it is there: read, not computed again


def _stream(rows: DataFrame, last: DataFrame, job) -> DataFrame:
    """What ``job`` of a stream of the rows has put out when all are read; ``last``: a row so late that it closes all windows."""
    spark = rows.sparkSession
    source, out, state = folder(spark), folder(spark), folder(spark)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(3 * files).write.parquet(source)  # three batches of files for all tasks
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    result = job(feed)

    def run():
        query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    for _ in range(2):  # the second one brings the batch after the watermark has moved
        run()
        last.write.mode("append").parquet(source)
    run()
    return spark.read.schema(result.schema).parquet(out)


def _far():
    return F.lit("2030-01-01").cast("timestamp").alias("ts")


@add("r1_stream_sessions", "WITH e AS (SELECT *, CASE WHEN start - lag(\"end\") OVER (PARTITION BY file_id ORDER BY start, word_id) <= 3600 THEN 0 ELSE 1 END AS new FROM fx_words), s AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id) AS k FROM e) SELECT file_id, string_agg(word, ' ' ORDER BY start, word_id) AS text, round(min(start), 3) AS start, round(max(\"end\"), 3) AS \"end\", count(*) AS n_words FROM s GROUP BY file_id, k", "fx_words")
def _(words):
    rows = words.withColumn("ts", F.timestamp_micros(F.round(F.col("start") * 1000000).cast("long")))
    last = rows.limit(1).select(F.lit(-1).cast("long").alias("file_id"), "word_id", "word", F.lit(1e9).alias("start"), F.lit(1e9).alias("end"), _far())
    got = _stream(rows, last, lambda df: live.stream_sessions(df, 3600.0, "400 days"))
    return got.where("file_id >= 0").select("file_id", "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n_words")


@add("r2_stream_gate_counts", "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2", "events")
def _(events):
    rows = events.select(F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    got = _stream(rows, rows.limit(1).select(F.lit("late").alias("status"), _far()), lambda df: live.stream_gate_counts(df, "1 day", "400 days"))
    return got.where("status <> 'late'").select((F.unix_micros("start") / 1000000).cast("long").alias("start"), "status", "n")
