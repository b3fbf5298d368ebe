"""Queries on joins, rates, stress, frame verdicts, exercises and programs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.functions import phonetics as P
from speechlab.operators import classifiers as C
from speechlab.operators import frames as K
from speechlab.operators import joins as J
from speechlab.operators import metrics as G
from speechlab.operators import programs as R
from speechlab.operators import selection as E
from speechlab.operators import windows as W
from speechlab.operators.alignment import knn_probabilities
from speechlab.operators.hot import join_frequent
from speechlab.plans.registry import add
from speechlab.plans.scratch import kept, tasks_for


def _long(col: str):
    return F.col(col).cast("long").alias(col)


def _r(col: str):
    return F.round(F.col(col), 6).alias(col)


# joins
@add("j2_silent_lead", "SELECT rec_id, frame_idx, label, CASE WHEN frame_idx < rec_id % 7 THEN '[SIL]' ELSE CAST((frame_idx - rec_id % 7) // 10 AS VARCHAR) END AS phone FROM fx_frames WHERE frame_idx < 40 + rec_id % 7", "fx_frames", "fx_targets")
def _(frames, targets):
    start = (F.col("pos") * 10 + F.col("rec_id") % 7) * 0.25
    intervals = targets.where("pos < 4").select("rec_id", F.col("pos").alias("phone"), start.alias("start"), (start + 2.5).alias("end"))
    return J.label_frames(frames.select("rec_id", "frame_idx", "label"), intervals, 0.25, "[SIL]").select("rec_id", "frame_idx", "label", "phone")


@add("j4_attach_paths", "SELECT c_custkey, 'clips/' || c_custkey % 3 || '/k' || c_custkey || '.x.wav' AS path FROM customer WHERE c_custkey % 2 = 0", "customer")
def _(customer):
    name = F.concat(F.lit("k"), F.col("c_custkey").cast("string"), F.lit(".x"))
    files = customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("clips/"), (F.col("c_custkey") % 3).cast("string"), F.lit("/"), name, F.lit(".wav")).alias("path"))
    return J.attach_paths(customer.select("c_custkey", name.alias("key")), files, "key").select("c_custkey", "path")


@add("j8_voiced_inflections", "WITH k AS (SELECT word, string_split(phones, '_')[-1] AS p FROM fx_lexicon WHERE alt_idx = 0) SELECT a.word AS base, b.word AS inflected FROM k a JOIN k b ON b.word = a.word || 's' WHERE b.p IN ('S', 'Z') AND a.p NOT IN ('S', 'Z')", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return J.inflection_pairs(tokens, lexicon, "s", ("S", "Z"))


@add("j10_adversary_grid", "WITH r AS (SELECT rec, target AS p, detection AS a, status = 'F' AS t FROM fx_detect), e AS (SELECT DISTINCT p AS expected FROM r WHERE p <> 'N') SELECT rec, expected, p = expected OR a = expected AS match, NOT t OR NOT (p = expected OR a = expected) AS should_reject FROM r, e", "fx_detect")
def _(detect):
    rows = detect.select("rec", F.when(F.col("target") != "N", F.col("target")).otherwise("").alias("phonetics"), F.col("detection").alias("alt_phonetics"), (F.col("status") == "F").alias("target"))
    return J.adversary_grid(rows).select("rec", "expected", "match", "should_reject")


@add("j13_transfer_index", "WITH a AS (SELECT word, string_split_regex(phonetics, '[|_]') AS x, length(word) % 4 AS k FROM fx_phon), b AS (SELECT *, list_position(x, 'T') - 1 AS ix FROM a) SELECT word, CASE WHEN k > 0 AND ix IS NOT NULL AND ix >= 0 THEN CASE k WHEN 1 THEN ix WHEN 2 THEN ix + 1 WHEN 3 THEN CASE WHEN ix > 0 THEN ix - 1 END END END AS idx, CASE WHEN k = 0 THEN 'error: alignment failure' WHEN coalesce(ix, -1) < 0 THEN 'error: target phoneme not in word' WHEN k = 3 AND ix = 0 THEN 'other' ELSE 'success' END AS status FROM b", "fx_phon")
def _(phon):
    x, k = P.phones(F.col("phonetics")), F.length("word") % 4
    others = F.when(k == 1, x).when(k == 2, F.concat(F.array(F.lit("ZZ")), x)).when(k == 3, F.slice(x, 2, F.size(x)))
    rows = phon.select("word", "phonetics", F.lit(0).alias("word_idx"), F.lit("T").alias("target"), others.alias("others"))
    status = F.when(F.col("status").isin("success", "error: alignment failure", "error: target phoneme not in word"), F.col("status")).otherwise("other")
    return J.transfer_index(rows).select("word", F.col("index").alias("idx"), status.alias("status"))


@add("j14_attach_phrases", "WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS number, text FROM benchmark) SELECT event_id, item_id AS id, array_to_string(list_transform(list_filter(string_split(replace(text, 'a', 'a*'), ' '), lambda w: w <> ''), lambda w: CAST(contains(w, '*') AS INT)), '') AS bins FROM events JOIN o ON number = event_id % 40", "events", "benchmark")
def _(events, items):
    ranked = items.selectExpr("item_id as id", "row_number() over (order by item_id) as number")  # a content list
    files = events.select("event_id", F.concat(F.lit("s/Task1_"), F.col("event_id").cast("string"), F.lit("_m0"), (F.col("event_id") % 40).cast("string"), F.lit(".wav")).alias("path"))
    phrases = items.select(F.col("item_id").alias("id"), F.replace("text", F.lit("a"), F.lit("a*")).alias("text"))
    out = J.attach_phrases(files, ranked.select("id", F.col("number").cast("long").alias("number")), phrases)
    return out.select(F.regexp_extract("path", "_([0-9]+)_m", 1).cast("long").alias("event_id"), "id", F.array_join(F.transform("bins", lambda b: b.cast("string")), "").alias("bins"))


# rates
@add("g10_error_ranking_share", "SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS n_errors, count(*) AS n, round((SELECT avg(CAST(l_returnflag = 'R' AS DOUBLE)) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0", "lineitem")
def _(lineitem):
    return G.error_ranking(lineitem, ["l_partkey"], F.col("l_returnflag") == "R").select("l_partkey", "n_errors", "n", _r("share"))


@add("g12_mismatched_control", "WITH i AS (SELECT rec_id, coalesce(lead(rec_id) OVER (ORDER BY rec_id), first_value(rec_id) OVER (ORDER BY rec_id)) AS b FROM (SELECT DISTINCT rec_id FROM fx_frames)), l AS (SELECT i.b, f.frame_idx, f.label % 10 AS t FROM fx_frames f JOIN i ON i.rec_id = f.rec_id WHERE f.label % 10 <> 9) SELECT f.rec_id, round(avg(probs[CAST(t + 1 AS INT)]), 6) AS mean, round(median(probs[CAST(t + 1 AS INT)]), 6) AS median FROM fx_frames f JOIN l ON l.b = f.rec_id AND l.frame_idx = f.frame_idx GROUP BY 1", "fx_frames")
def _(frames):
    return G.mismatched_truth_stats(frames, F.col("label") % 10, 9).select("rec_id", _r("mean"), _r("median"))


_SEG = "SELECT word, syl_idx, pos, phone, CASE WHEN length(word) % 5 = 0 AND pos = 0 THEN '[SIL]' WHEN (length(word) + pos) % 7 = 0 THEN 'K' ELSE phone END AS found FROM fx_phones_of_word"


@add("g13_match_rates", f"WITH s AS ({_SEG}), y AS (SELECT word, syl_idx, string_agg(phone, '_' ORDER BY pos) AS t, coalesce(string_agg(found, '_' ORDER BY pos) FILTER (found <> '[SIL]'), '') AS f, count(*) AS n, count(*) FILTER (phone <> found AND found <> '[SIL]') AS bad FROM s GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n_phones, round(1 - sum(bad) / sum(n), 6) AS phone_rate, count(*) AS n_syllables, round(avg(CASE WHEN t = f THEN 1.0 ELSE 0.0 END), 6) AS syllable_rate FROM y", "fx_phones_of_word")
def _(phones):
    found = F.when((F.length("word") % 5 == 0) & (F.col("pos") == 0), "[SIL]").when((F.length("word") + F.col("pos")) % 7 == 0, "K").otherwise(F.col("phone"))
    out = G.match_rates(phones.withColumn("found", found), ["word", "syl_idx"])
    return out.select("n_phones", _r("phone_rate"), "n_syllables", _r("syllable_rate"))


_ORDER = "SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1"


def _order_lists(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))), lambda x: x["q"]).alias("q"))


@add("g14_sentence_stress", f"WITH a AS (SELECT l_orderkey, list_transform(q, lambda x, i: CAST(i = l_orderkey % 7 + 1 AS INT)) AS b, list_transform(q, lambda x: CAST(x > 25 AS INT)) AS f, len(q) AS n FROM ({_ORDER})), c AS (SELECT b, CASE WHEN l_orderkey % 5 = 0 THEN [] ELSE f END AS f, list_position(b, 1) - 1 AS ix, least(2, n) AS k, n FROM a WHERE list_sum(b) = 1), d AS (SELECT CASE WHEN ix < k THEN b[1:k] ELSE b[k+1:n] END AS b, CASE WHEN ix < k THEN f[1:k] ELSE f[k+1:n] END AS f, f[ix + 1] = 1 AS hit FROM c) SELECT count(*) AS n, round(sum(list_sum(b)) / sum(len(b)), 6) AS base_rate, round(sum(coalesce(list_sum(f), 0)) / sum(len(f)), 6) AS found_rate, round(avg(CASE WHEN len(f) = 0 THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, round(avg(CASE WHEN len(f) > 0 THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 6) AS hit_rate FROM d", "lineitem")
def _(lineitem):
    n = F.size("q")
    rows = _order_lists(lineitem).select(
        F.transform("q", lambda x, i: (i == F.col("l_orderkey") % 7).cast("int")).alias("bins"),
        F.when(F.col("l_orderkey") % 5 == 0, F.array().cast("array<int>")).otherwise(F.transform("q", lambda x: (x > 25).cast("int"))).alias("found"),
        F.filter(F.array(F.least(F.lit(2), n), n - F.least(F.lit(2), n)), lambda c: c > 0).alias("counts"),
    )
    return G.sentence_stress_eval(rows).select("n", *[_r(c) for c in ("base_rate", "found_rate", "failure_rate", "hit_rate")])


@add("g23_word_score_arrays", f"SELECT CAST(l_orderkey AS VARCHAR) AS sentence_id, 't' || l_orderkey AS text, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(q[1] AS DOUBLE) END AS total, array_to_string(q, ',') AS words_accuracy, array_to_string(list_transform(q, lambda x: 'P' || x), ',') AS words_phones, CASE l_orderkey % 2 WHEN 0 THEN 'train' ELSE 'test' END AS data_set FROM ({_ORDER})", "lineitem")
def _(lineitem):
    rows = _order_lists(lineitem)
    words = F.transform("q", lambda x: F.struct(x.cast("double").alias("accuracy"), F.lit(10.0).alias("stress"), F.array(F.concat(F.lit("P"), x.cast("string"))).alias("phones")))
    total = F.when(F.col("l_orderkey") % 3 != 0, F.get("q", F.lit(0)).cast("double"))
    scores = rows.select(F.col("l_orderkey").cast("string").alias("sentence_id"), F.to_json(F.struct(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("text"), total.alias("total"), words.alias("words"))).alias("json"))
    paths = lambda k: rows.where(F.col("l_orderkey") % 2 == k).select(F.col("l_orderkey").cast("string").alias("sentence_id"), F.lit("w").alias("wav_path"))
    out = G.word_score_arrays(scores, [("train", paths(0)), ("test", paths(1))])
    return out.select("sentence_id", "text", "total", F.array_join(F.transform("words_accuracy", lambda x: x.cast("long").cast("string")), ",").alias("words_accuracy"), F.array_join(F.flatten("words_phones"), ",").alias("words_phones"), "data_set")


@add("g25_answer_scores", "WITH a AS (SELECT l_suppkey AS student, l_partkey % 50 AS item, list(CAST(l_quantity > 35 AS INT) ORDER BY l_orderkey, l_linenumber, l_quantity) AS b FROM lineitem GROUP BY 1, 2) SELECT student, count(*) AS n_items, count(*) FILTER (list_position(b, 1) = item % 3 + 1) AS score FROM a GROUP BY 1", "lineitem")
def _(lineitem):
    rows = lineitem.groupBy(F.col("l_suppkey").alias("student"), (F.col("l_partkey") % 50).alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))), lambda x: (x["l_quantity"] > 35).cast("int")).alias("bins"))
    key = lineitem.select((F.col("l_partkey") % 50).alias("item")).distinct().withColumn("place", F.col("item") % 3 + 1)
    return G.answer_scores(rows, key)


# windows
@add("w2_run_blocks", "SELECT file_id, word_id, word FROM (SELECT *, lag(word) OVER w AS b, lead(word) OVER w AS a FROM fx_words WINDOW w AS (PARTITION BY file_id ORDER BY start, word_id)) WHERE b = word OR a = word", "fx_words")
def _(words):
    return W.run_blocks(words, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "word")


@add("o3_order_positions", "SELECT word, CAST(syl_idx AS BIGINT) AS syl_idx, position, row_number() OVER (PARTITION BY word, syl_idx ORDER BY CASE position WHEN 'start' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END) - 1 AS place FROM (SELECT DISTINCT word, syl_idx, CASE WHEN regexp_matches(phone, '[012]$') THEN 'middle' WHEN pos = 0 THEN 'start' ELSE 'end' END AS position FROM fx_phones_of_word)", "fx_phones_of_word")
def _(phones):
    position = F.when(F.col("phone").rlike("[012]$"), "middle").when(F.col("pos") == 0, "start").otherwise("end")
    rows = phones.select("word", _long("syl_idx"), position.alias("position")).distinct()
    return W.order_positions(rows, ["word", "syl_idx"])


_LINES = "(SELECT l_orderkey AS rec_id, l_linenumber AS word, max(CAST(l_quantity AS BIGINT)) * 2 AS q FROM lineitem GROUP BY 1, 2)"


@add("w14_stress_table", f"WITH s AS (SELECT rec_id, CAST(word // 2 AS BIGINT) AS chunk, CAST(word AS BIGINT) AS word, CAST(unnest([0, 1]) AS BIGINT) AS syllable, q FROM {_LINES}), v AS (SELECT *, (q * (syllable + 3)) % 101 AS score FROM s), w AS (SELECT *, row_number() OVER (PARTITION BY rec_id, word ORDER BY score DESC, syllable) = 1 AS first, max(score) OVER (PARTITION BY rec_id, word) AS top FROM v), c AS (SELECT rec_id, chunk, word, row_number() OVER (PARTITION BY rec_id, chunk ORDER BY top DESC, word) AS k, count(*) OVER (PARTITION BY rec_id, chunk) AS n, top FROM (SELECT DISTINCT rec_id, chunk, word, top FROM w)) SELECT w.rec_id, w.word, w.syllable, CAST(w.first AS INT) AS word_bit, CAST(n = 1 OR (k <= ceil(n / 3.0) AND c.top >= 60) AS INT) AS sentence_bit FROM w JOIN c ON c.rec_id = w.rec_id AND c.word = w.word", "lineitem")
def _(lineitem):
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition(tasks_for(lineitem), "l_orderkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("rec_id"), _long("l_linenumber").alias("word")).agg((F.max(F.col("l_quantity").cast("long")) * 2).alias("q"))
    rows = rows.select("rec_id", F.floor(F.col("word") / 2).alias("chunk"), "word", "q", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("syllable"))
    rows = rows.withColumn("score", (F.col("q") * (F.col("syllable") + 3)) % 101)
    return W.stress_table(rows.drop("q")).select("rec_id", "word", "syllable", "word_bit", "sentence_bit")


# sets
@add("o4_tagged_union_operator", "SELECT 'benchmark' AS source, item_id, CAST(NULL AS BIGINT) AS doc_id, length(text) AS n FROM benchmark UNION ALL SELECT 'documents', NULL, doc_id, length(text) FROM documents", "documents", "benchmark")
def _(docs, items):
    n = F.length("text").cast("long").alias("n")
    return E.tagged_union([("benchmark", items.select("item_id", n)), ("documents", docs.select("doc_id", n))]).select("source", "item_id", "doc_id", "n")


@add("o5_inventory_sides", "WITH a AS (SELECT DISTINCT word FROM fx_tokens WHERE lang = 'en'), b AS (SELECT DISTINCT word FROM fx_tokens WHERE lang = 'fr') SELECT coalesce(a.word, b.word) AS word, CASE WHEN b.word IS NULL THEN 'left' WHEN a.word IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.word = b.word", "fx_tokens")
def _(tokens):
    return E.inventory_diff(tokens.where("lang = 'en'"), tokens.where("lang = 'fr'"), "word")


# selections
_F4 = "CASE WHEN ends_with(word, 'ed') AND regexp_matches(phones, '_[A-Z]+0_D$') THEN 'ed:syllable' WHEN ends_with(word, 'ed') AND ends_with(phones, '_D') THEN 'ed:D' WHEN ends_with(word, 's') AND regexp_matches(phones, '_[AI]H0_Z$') THEN 's:syllable' WHEN ends_with(word, 's') AND ends_with(phones, '_S') THEN 's:S' WHEN ends_with(word, 's') AND ends_with(phones, '_Z') THEN 's:Z' WHEN starts_with(word, 'h') AND starts_with(phones, 'HH') THEN 'h:sounded' WHEN starts_with(word, 'h') THEN 'h:silent' END"


@add("f4_ending_and_h", f"SELECT word, {_F4} AS class FROM (SELECT word, CASE WHEN starts_with(word, 'ha') THEN substring(phones, 4) WHEN ends_with(word, 'is') THEN regexp_replace(phones, '_S$', '_Z') ELSE phones END AS phones FROM fx_lexicon WHERE alt_idx = 0)", "fx_lexicon")
def _(lexicon):
    phones = F.when(F.col("word").startswith("ha"), F.substring("phones", 4, 1000)).when(F.col("word").endswith("is"), F.regexp_replace("phones", "_S$", "_Z")).otherwise(F.col("phones"))
    rows = lexicon.where("alt_idx = 0").withColumn("phones", phones)
    return rows.select("word", E.ending_class(F.col("word"), F.col("phones")).alias("class"))


@add("f8_select_ed", "WITH c AS (SELECT word, count(*) AS n FROM fx_tokens GROUP BY 1), l AS (SELECT word, regexp_replace(regexp_replace(phones, '_(EH0|EH1)_D$', '_D'), '_(T|D)_D$', '_\\1_IH0_D') AS p FROM fx_lexicon WHERE alt_idx = 0 AND ends_with(word, 'ed')), s AS (SELECT l.word, n, p, regexp_matches(p, '_IH[0-2]_D$') AS long FROM l JOIN c ON c.word = l.word), x AS (SELECT word, n, CASE WHEN long THEN string_split(p, '_')[-3] ELSE string_split(p, '_')[-2] END AS phone, CASE WHEN long THEN 'IH0_D' ELSE 'D' END AS said FROM s), e AS (SELECT *, CASE WHEN phone IN ('T', 'D') THEN 'IH0_D' WHEN phone IN ('CH', 'F', 'HH', 'K', 'P', 'S', 'SH', 'TH') THEN 'T' ELSE 'D' END AS ending FROM x WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '[012]$')) SELECT phone, ending, word, row_number() OVER (PARTITION BY phone ORDER BY n DESC, word) AS rank FROM e WHERE said = ending QUALIFY row_number() OVER (PARTITION BY phone ORDER BY n DESC, word) <= 5", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    said = F.regexp_replace(F.regexp_replace("phones", "_(EH0|EH1)_D$", "_D"), "_(T|D)_D$", "_$1_IH0_D")
    words = lexicon.where("alt_idx = 0").select("word", said.alias("phones")).join(tokens.groupBy("word").agg(F.count("*").alias("n")), "word")
    return E.select_ed(words, 5)


@add("f10_format_selection", "WITH f AS (SELECT doc_id AS file_id, pos, word FROM fx_tokens), k AS (SELECT file_id, pos, coalesce(phonetics, 'AH0') AS p FROM f LEFT JOIN fx_phon USING (word)), s AS (SELECT file_id, string_agg(p, ' ' ORDER BY pos) AS phonetics FROM k GROUP BY 1) SELECT k.file_id, CAST(pos AS BIGINT) AS word_idx, phonetics, nullif(list_position(list_transform(string_split(p, '|'), lambda y: list_contains(string_split(y, '_'), 'T')), true) - 1, -1) AS syllable FROM k JOIN s USING (file_id) WHERE pos = 3", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    rows = tokens.join(lexicon.where("alt_idx = 0"), "word", "left").select(F.col("doc_id").alias("file_id"), _long("pos").alias("word_idx"), "phones")
    return E.format_selection(rows.where("word_idx = 3").select("file_id", "word_idx"), rows, "T")


@add("f11_annotated_selection", "WITH r AS (SELECT word, phonetics, CASE WHEN length(word) % 2 = 0 THEN 'without the sound h at the beginning' ELSE 'h' END AS rule FROM fx_phon WHERE starts_with(word, 'h') OR ends_with(word, 's')), k AS (SELECT word, rule, phonetics, CASE WHEN starts_with(word, 'h') THEN CASE WHEN rule <> 'h' THEN 'h:silent' ELSE 'h:sounded' END WHEN regexp_matches(replace(phonetics, '|', '_'), '[AI]H0_Z$') THEN 's:syllable' WHEN ends_with(replace(phonetics, '|', '_'), '_S') THEN 's:S' ELSE 's:Z' END AS kind FROM r) SELECT word, CAST(1 AS BIGINT) AS word_idx, kind, CASE kind WHEN 'h:silent' THEN 0 WHEN 'h:sounded' THEN list_position(list_transform(string_split(phonetics, '|'), lambda s: contains(s, 'HH')), true) - 1 ELSE -1 END AS syllable FROM k", "fx_phon")
def _(phon):
    rule = F.when(F.length("word") % 2 == 0, "without the sound h at the beginning").otherwise("h")
    rows = phon.select(F.concat(F.lit("The *"), "word", F.lit("* is.")).alias("text"), F.concat(F.lit("DH_AH0 "), "phonetics", F.lit(" IH1_Z")).alias("phonetics"), rule.alias("rule"))
    return E.annotated_selection(rows).select("word", "word_idx", "kind", "syllable")


# exercises
@add("e5_stress_triplets", None, "fx_lexicon")
def _(lexicon):
    varied = F.when(F.length("word") % 2 == 0, F.col("phones")).otherwise(F.translate("phones", "01", "10"))
    return E.stress_triplets(lexicon.withColumn("phones", varied), 20, "trip")


_STAR = "SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3 FROM fx_tokens"
_HIT = "(SELECT word, len(list_filter(string_split(phones, '_'), lambda p: regexp_matches(p, 'IH|EH'))) AS h FROM fx_lexicon WHERE alt_idx = 0)"


def _triples(tokens: DataFrame) -> DataFrame:
    """Three neighbouring words, the middle one starred."""
    first = tokens.selectExpr("doc_id", "pos", "word", "lead(word) over (partition by doc_id order by pos) as w2", "lead(word, 2) over (partition by doc_id order by pos) as w3")
    rows = first.where("w3 is not null and pos % 3 = 0")
    return rows.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("sent_id"), F.concat("word", F.lit(" *"), "w2", F.lit("* "), "w3").alias("text"))


@add("e8_fix_focus", f"WITH s AS (SELECT doc_id || '-' || pos AS sent_id, word AS a, w2 AS b, w3 AS c FROM ({_STAR}) WHERE w3 IS NOT NULL AND pos % 3 = 0), h AS (SELECT s.*, coalesce(x.h, 0) * length(a) AS ha, coalesce(y.h, 0) * length(b) AS hb, coalesce(z.h, 0) * length(c) AS hc FROM s LEFT JOIN {_HIT} x ON x.word = a LEFT JOIN {_HIT} y ON y.word = b LEFT JOIN {_HIT} z ON z.word = c) SELECT sent_id, CASE WHEN hb > 0 AND regexp_full_match(b, '[A-Za-z]+') THEN a || ' *' || b || '* ' || c WHEN ha >= hb AND ha >= hc THEN '*' || a || '* ' || b || ' ' || c WHEN hb >= hc THEN a || ' *' || b || '* ' || c ELSE a || ' ' || b || ' *' || c || '*' END AS text FROM h WHERE greatest(ha, hb, hc) > 0", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return E.fix_focus(_triples(tokens), lexicon, ["IH", "EH"]).select("sent_id", "text")


@add("e9_filter_cards", f"SELECT doc_id || '-' || pos AS sent_id FROM ({_STAR}) WHERE w3 IS NOT NULL AND pos % 3 = 0 AND w2 IN (SELECT word FROM fx_lexicon WHERE alt_idx = 0 AND regexp_matches(phones, '(IH|IY)[012]'))", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return E.filter_cards(_triples(tokens), lexicon, "vowel").select("sent_id")


@add("e9_filter_ed_cards", f"SELECT doc_id || '-' || pos AS sent_id FROM ({_STAR}) WHERE w3 IS NOT NULL AND pos % 3 = 0 AND ends_with(w2, 'ed')", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return E.filter_cards(_triples(tokens), lexicon, "ed").select("sent_id")


@add("e10_parse_dialogues", "SELECT event_id, event_type AS question, 'u' || user_id AS answer FROM events WHERE event_id % 5 > 0", "events")
def _(events):
    line = F.when(F.col("event_id") % 5 > 0, F.concat("event_type", F.lit(" | u"), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    return E.parse_dialogues(events.select("event_id", line.alias("line"))).select("event_id", "question", "answer")


@add("e11_starred", "SELECT event_id FROM events WHERE event_id % 4 = 0 ORDER BY event_id LIMIT 60", "events")
def _(events):
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("*"), "event_type", F.lit("*"))).otherwise(F.col("event_type"))
    return E.starred(events.select("event_id", text.alias("text")), 60, "event_id").select("event_id")


@add("e12_parse_records", "SELECT event_id, '*' || event_type || '*' AS question, '*u' || user_id || '* x' AS answer FROM events WHERE event_id % 3 > 0 ORDER BY event_id LIMIT 80", "events")
def _(events):
    body = F.concat(F.lit("{'question': '*"), "event_type", F.lit("*', 'answer': '*u"), F.col("user_id").cast("string"), F.lit("* x'"))
    line = F.concat(F.lit("1. "), body, F.when(F.col("event_id") % 3 > 0, "}").otherwise(" }}x{"))
    out = E.parse_records(events.select("event_id", line.alias("line")), 2, 80, "event_id")
    return out.select("event_id", F.try_element_at("record", F.lit("question")).alias("question"), F.try_element_at("record", F.lit("answer")).alias("answer"))


@add("e13_ed_pairs", f"WITH l AS (SELECT doc_id, pos, word || 'ed' AS a, w2 || CASE WHEN pos % 2 = 0 THEN 'ed' ELSE 'e' END AS b FROM ({_STAR}) WHERE w2 IS NOT NULL) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN md5(a || '/' || b || '-side')[1] < '8' THEN a ELSE b END AS target, CASE WHEN md5(a || '/' || b || '-side')[1] < '8' THEN b ELSE a END AS incorrect FROM l WHERE ends_with(b, 'ed')", "fx_neighbours")
def _(neighbours):
    rows = neighbours.select("doc_id", "pos", "word", F.col("next").alias("w2")).where("w2 is not null")
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.concat("word", F.lit("ed/"), "w2", F.when(F.col("pos") % 2 == 0, "ed").otherwise("e")))
    return E.ed_pairs(rows.withColumn("line", line), "side").select("doc_id", _long("pos"), "target", "incorrect")


# frames
@add("k1_pca_frames", None, "embeddings")
def _(embeddings):
    fitted = C.fit_pca(embeddings, 0.95, "embedding")
    out = C.reduce_frames(embeddings, fitted, "embedding")
    return out.select("vec_id", "label", F.size("embedding").alias("n_components"), F.round(F.get("embedding", F.lit(0)), 4).alias("first"))


@add("k5_logistic_frames", None, "embeddings")
def _(embeddings):
    rows = embeddings.withColumn("phone", F.concat(F.lit("P"), F.col("label").cast("string")))
    out = C.classify_frames(rows, C.fit_logreg(rows, "embedding"), "embedding")
    return out.select("vec_id", "phone", "predicted", F.round(F.array_max("probs"), 4).alias("p"))


@add("k24_projection", None, "embeddings")
def _(embeddings):
    return C.project_2d(embeddings, "label", "embedding")


@add("k11_pool_max", "SELECT label, phone, round(max(p), 6) AS p FROM (SELECT label, CAST(unnest(range(10)) AS BIGINT) AS phone, unnest(probs) AS p FROM fx_frames) GROUP BY 1, 2", "fx_frames")
def _(frames):
    return K.pool(frames, ["label"], "max").select("label", _long("phone"), _r("p"))


_RUN = "SELECT rec_id, frame_idx, frame_idx // 10 AS pos, CASE WHEN frame_idx // 10 IN (1, 2) THEN 3 ELSE 4 END AS phone_id FROM fx_frames WHERE frame_idx <> 19"
# the frames of k neighbouring positions of one phone are dealt to them, floor(n / k) each, the rest to the last
_SHARED = f"WITH r AS ({_RUN}), t AS (SELECT *, CAST(lag(phone_id) OVER (PARTITION BY rec_id ORDER BY pos) IS DISTINCT FROM phone_id AS INT) AS new FROM (SELECT DISTINCT rec_id, pos, phone_id FROM r)), g AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM t), c AS (SELECT *, count(*) OVER (PARTITION BY rec_id, run) AS k, min(pos) OVER (PARTITION BY rec_id, run) AS low FROM g), f AS (SELECT r.rec_id, r.frame_idx, r.phone_id, k, low, row_number() OVER (PARTITION BY r.rec_id, run ORDER BY r.frame_idx) - 1 AS place, count(*) OVER (PARTITION BY r.rec_id, run) AS n FROM r JOIN c ON c.rec_id = r.rec_id AND c.pos = r.pos) SELECT rec_id, frame_idx, phone_id, low + least(place // greatest(n // k, 1), k - 1) AS pos FROM f"


def _path(frames: DataFrame) -> DataFrame:
    pos = F.expr("cast(frame_idx div 10 as bigint)")
    return frames.where("frame_idx <> 19").select("rec_id", "frame_idx", pos.alias("pos"), F.when(pos.isin(1, 2), 3).otherwise(4).alias("phone_id"))


@add("k11_shared_runs", f"SELECT rec_id, frame_idx, CAST(pos AS BIGINT) AS pos FROM ({_SHARED})", "fx_frames")
def _(frames):
    return K.halve_shared_runs(_path(frames)).select("rec_id", "frame_idx", "pos")


@add("k12_pooled_segments", f'WITH s AS ({_SHARED}), p AS (SELECT rec_id, pos, phone_id, list(probs) AS a, count(*) AS n_frames, min(frame_idx) * 0.02::DOUBLE AS start, (max(frame_idx) + 1) * 0.02::DOUBLE AS "end" FROM s JOIN fx_frames USING (rec_id, frame_idx) GROUP BY 1, 2, 3), m AS (SELECT *, list_transform(range(10), lambda k: list_avg(list_transform(a, lambda v: v[k + 1]))) AS q FROM p) SELECT rec_id, CAST(pos AS BIGINT) AS pos, n_frames, CAST(round(CAST(q[phone_id + 1] AS DECIMAL(12, 9)), 5) AS DOUBLE) AS p_true, CAST(round(CAST(list_max(q) AS DECIMAL(12, 9)), 5) AS DOUBLE) AS p_predicted, round(start, 6) AS start, round("end", 6) AS "end" FROM m', "fx_frames")
def _(frames):
    out = K.pooled_segments(_path(frames), frames)
    told = lambda c: F.round(F.round(c, 9), 5).alias(c)  # noqa: E731  (means of ten six-digit numbers often are halves of the fifth digit)
    return out.select("rec_id", "pos", "n_frames", told("p_true"), told("p_predicted"), _r("start"), _r("end"))


@add("k13_word_segments", "SELECT word, syl_idx, CAST(pos AS BIGINT) AS pos, phone FROM (SELECT word, CAST(syl_idx AS BIGINT) AS syl_idx, pos, phone FROM fx_phones_of_word) WHERE syl_idx = 1", "fx_phones_of_word")
def _(phones):
    segments = phones.select(F.concat_ws("-", "word", F.col("syl_idx").cast("string")).alias("rec_id"), _long("pos"), "phone")
    indexed = phones.select(F.concat_ws("-", "word", F.col("syl_idx").cast("string")).alias("rec_id"), _long("pos"), F.col("syl_idx").alias("word_idx"))
    out = K.word_segments(segments, indexed, 1)
    return out.select(F.regexp_extract("rec_id", "^(.*)-", 1).alias("word"), F.col("word_idx").cast("long").alias("syl_idx"), "pos", "phone")


@add("k16_cluster_contrast", "WITH w AS (SELECT word, syl_idx, list(phone ORDER BY pos) AS s FROM fx_phones_of_word GROUP BY 1, 2 HAVING count(*) = 3) SELECT word, CASE length(word) % 4 WHEN 0 THEN s[3] WHEN 1 THEN s[3] WHEN 2 THEN 'Q' ELSE regexp_replace(s[2], '[012]$', '') END AS detection FROM w", "fx_phones_of_word")
def _(phones):
    rows = phones.groupBy("word", "syl_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phone"))), lambda x: x["phone"]).alias("s")).where(F.size("s") == 3)
    k = F.length("word") % 4
    last = F.when(k == 0, F.element_at("s", -1)).when(k == 1, F.lit("TZ")).when(k == 2, F.lit("Q")).otherwise(F.lit("[SIL]"))
    found = F.concat(F.slice("s", 1, 2), F.array(last))
    segments = F.transform(found, lambda p, i: F.struct(p.alias("found"), (i * 0.1).alias("start"), (i * 0.1 + 0.1).alias("end")))
    short = F.array(F.struct(F.lit("K").alias("found"), F.lit(0.0).alias("start"), F.lit(0.02).alias("end")))
    truth = F.transform(F.slice("s", 2, 2), lambda p: F.regexp_replace(p, "[012]$", ""))
    rows = rows.select(F.col("word").alias("rec_id"), F.concat(short, segments).alias("segments"), truth.alias("truth"), F.col("s").alias("syllable"), F.slice("s", 3, 1).alias("target"), F.lit(1).alias("n_basis"))
    consonants = sorted({p for ps in P.CATEGORIES.values() for p in ps})
    return K.cluster_contrast(rows, {p: ["TZ"] for p in consonants}, {"IH_D": ["AH_D"]}).select(F.col("rec_id").alias("word"), "detection")


@add("k18_all_aspects", "WITH p AS (SELECT word AS rec, CAST(syl_idx AS BIGINT) AS syllable, phone, CASE WHEN regexp_matches(phone, '[012]$') THEN 'middle' WHEN pos = 0 THEN 'start' ELSE 'end' END AS position FROM fx_phones_of_word) SELECT rec, syllable, position, phone AS phones, row_number() OVER (PARTITION BY rec, syllable ORDER BY CASE position WHEN 'start' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END) - 1 AS place, CAST(syllable * 10 AS BIGINT) AS score, CAST(syllable = 0 AS INT) AS word_bit FROM p", "fx_phones_of_word")
def _(phones):
    rows = phones.select(F.col("word").alias("rec_id"), F.lit(0).alias("word"), _long("syl_idx").alias("syllable"), F.col("phone").alias("phones"), F.col("phone").alias("detection"), "pos")
    vowel = F.col("phones").rlike("[012]$")
    clusters = rows.where(~vowel).withColumn("position", F.when(F.col("pos") == 0, "start").otherwise("end"))
    stress = rows.where(vowel).select("rec_id", "word", "syllable", (F.col("syllable") * 10).alias("score"), (F.col("syllable") == 0).cast("int").alias("word_bit"), F.lit(0).alias("sentence_bit"))
    return K.all_aspects(rows.where(vowel), clusters, stress).select(F.col("rec_id").alias("rec"), "syllable", "position", "phones", "place", "score", "word_bit")


@add("k20_detected_flag", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'speech' WHEN 1 THEN 'empty_audio' WHEN 2 THEN 'too_short' WHEN 3 THEN 'too_long' WHEN 4 THEN 'too_quiet' WHEN 5 THEN 'too_quiet' ELSE 'nonsense' END AS flag FROM events", "events")
def _(events):
    names = F.array(*map(F.lit, ["success", "empty", "too short", "too long", "too quiet", "no sound", "no pitch", "other"]))
    return events.select("event_id", K.detected_flag(F.get(names, (F.col("event_id") % 8).cast("int"))).alias("flag"))


@add("k21_recording_check", "WITH b AS (SELECT rec_id, frame_idx, list_position(probs, list_max(probs)) - 1 AS phone, list_max(probs) AS p FROM fx_frames), k AS (SELECT *, CAST(lag(phone) OVER (PARTITION BY rec_id ORDER BY frame_idx) IS DISTINCT FROM phone AS INT) AS new FROM b WHERE phone <> 9), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS BIGINT) AS run FROM k), a AS (SELECT rec_id, run, phone, min(frame_idx) AS f FROM r GROUP BY 1, 2, 3 HAVING max(p) > 0.25), n AS (SELECT rec_id, sum(new) AS n FROM (SELECT rec_id, CAST(lag(phone) OVER (PARTITION BY rec_id ORDER BY f) IS DISTINCT FROM phone AS INT) AS new FROM a) GROUP BY 1), e AS (SELECT rec_id, count(*) AS m FROM fx_targets GROUP BY 1) SELECT e.rec_id, round((SELECT avg(CASE WHEN phone = 9 THEN 1.0 ELSE 0.0 END) FROM b WHERE b.rec_id = e.rec_id), 6) AS silent_share, round(coalesce(n, 0) / m, 6) AS count_ratio FROM e LEFT JOIN n USING (rec_id)", "fx_frames", "fx_targets")
def _(frames, targets):
    return K.recording_check(frames, targets, 0.25, 9).select("rec_id", _r("silent_share"), _r("count_ratio"))


@add("k21_error_rates", None, "fx_frames", "fx_targets")
def _(frames, targets):
    return K.recording_check(frames, targets, 0.25, 9).select("rec_id", _r("error_rate"), _r("standard_rate"))


@add("k23_evaluate", "SELECT rec || status AS rec, CASE WHEN status = 'F' THEN 'ok' WHEN rec % 3 = 0 THEN 'no result' ELSE 'phonetics is null' END AS out FROM fx_detect WHERE status = 'F' OR rec % 2 = 0", "fx_detect")
def _(detect):
    key = F.concat(F.col("rec").cast("string"), "status").alias("rec")
    rows = detect.where("status = 'F' or rec % 2 = 0").select(key, "status", F.when((F.col("status") == "F") | (F.col("rec") % 3 == 0), F.col("target")).alias("phonetics"))
    good, bad = K.evaluate(rows, lambda df: df.where("status = 'F'").select("rec", F.lit("ok").alias("out")), "rec", ["phonetics"])
    return good.unionByName(bad.select("rec", F.col("error").alias("out")))


# programs
def _program(region, nation, customer, orders, lineitem) -> DataFrame:
    """Regions, nations, customers, orders and items as programs of five levels, one for each customer.

    A nation without customers, and a region without nations, is one of its own, so a row holds no more than a customer's orders.
    """
    phrase = F.create_map(F.lit(" Flag"), "l_returnflag", F.lit("aspect"), F.col("l_linenumber").cast("string"))
    items = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.map_entries(phrase).alias("m")))).alias("items"))
    each = F.struct(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("aspect"), F.col("items").alias("items"))
    own = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg(F.array_sort(F.collect_list(each)).alias("own"))
    phrases = lambda e: F.transform(e["items"], lambda x: F.map_from_entries(x["m"]))
    exercises = F.transform("own", lambda e: F.struct(e["name"].alias("name"), e["aspect"].alias("aspect"), phrases(e).alias("phrases")))
    activity = F.struct(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("type"), exercises.alias("exercises"))
    places = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")  # a few rows, of many customers each
    rows = F.broadcast(places).join(customer.where("c_nationkey is not null"), F.col("c_nationkey") == F.col("n_nationkey"))
    lone = places.join(customer.select("c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")
    rows = rows.join(own, F.col("o_custkey") == F.col("c_custkey"), "left").select("r_regionkey", "n_nationkey", activity.alias("activity"))
    rows = rows.unionByName(lone.select("r_regionkey", "n_nationkey"), allowMissingColumns=True)

    def one(there, member):
        return F.filter(F.array(F.when(there.isNotNull(), member)), lambda x: x.isNotNull())

    sets = one(F.col("n_nationkey"), F.struct(F.col("n_nationkey").alias("name"), one(F.col("activity"), F.col("activity")).alias("activities")))
    return rows.select(F.array(F.struct(F.col("r_regionkey").alias("name"), sets.alias("sets"))).alias("modules"))


_FLAT = "SELECT r_regionkey AS module, n_nationkey AS set, c_custkey AS activity, o_orderkey AS exercise, l_returnflag AS flag, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(CAST(l_linenumber AS VARCHAR), o_orderstatus) ELSE o_orderstatus END AS aspect FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey"
_TABLES = ("region", "nation", "customer", "orders", "lineitem")


@add("n1_flatten_program", _FLAT, *_TABLES)
def _(*tables):
    flat = R.flatten_program(_program(*tables), ("BUILDING",))
    return flat.select("module", "set", "activity", "exercise", F.try_element_at("phrase", F.lit(" Flag")).alias("flag"), "aspect")


@add("n2_nest_program", "SELECT c_custkey % 4 AS module, count(DISTINCT o_orderkey) AS n_exercises, count(*) AS n_phrases, min(o_orderkey) AS first FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", "customer", "orders", "lineitem")
def _(customer, orders, lineitem):
    rows = customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    flat = rows.select((F.col("c_custkey") % 4).alias("module"), F.col("c_nationkey").alias("set"), F.col("c_custkey").alias("activity"), F.col("c_mktsegment").alias("type"), F.col("o_orderkey").alias("exercise"), F.col("o_orderstatus").alias("aspect"), F.create_map(F.lit("f"), "l_returnflag").alias("phrase"), (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("o"))
    again = R.flatten_program(R.nest_program(flat, "o"))
    first = F.min(F.struct("o_set", "o_activity", "o_exercise", "exercise"))["exercise"]
    return again.groupBy("module").agg(F.countDistinct("exercise").alias("n_exercises"), F.count("*").alias("n_phrases"), first.alias("first"))


@add("n3_clean_keys", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_returnflag AS mark, l_linestatus AS status FROM lineitem", "lineitem")
def _(lineitem):
    phrase = F.create_map(F.lit(" Flag"), F.concat("l_returnflag", F.lit(" ")), F.lit("Status "), F.col("l_linestatus"), F.lit("ID"), F.col("l_linenumber").cast("string"))
    out = R.clean_keys(lineitem.withColumn("phrase", phrase), {"flag": "mark"}, dropped=("id",))
    return out.where(F.size("phrase") == 2).select("l_orderkey", _long("l_linenumber"), "l_partkey", F.try_element_at("phrase", F.lit("mark")).alias("mark"), F.try_element_at("phrase", F.lit("status")).alias("status"))


@add("n4_program_sentences", "SELECT event_id, 'text' AS key, event_type AS sentence FROM events UNION ALL SELECT event_id, 'more', 'u' || user_id FROM events WHERE event_id % 3 > 0", "events")
def _(events):
    phrase = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("text"), F.col("event_type"), F.lit("more"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(""))
    return R.program_sentences(events.select("event_id", phrase.alias("phrase")), ("id",))


@add("n5_parse_filenames", "SELECT event_id, CAST(user_id AS VARCHAR) AS speaker, event_type AS task, CASE event_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'patient' END AS kind FROM events", "events")
def _(events):
    name = F.concat_ws("__", F.col("user_id").cast("string"), "event_type", F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string")))
    out = R.parse_filenames(events.select("event_id", name.alias("name")), "name", ["speaker", "task", "kind"], {"kind": {"P0": "control", "P1": "patient"}})
    return out.select("event_id", "speaker", "task", "kind")


# operators of rows that stood in queries alone
@add("j3_attach_alignments", "SELECT c_custkey, n FROM customer JOIN (SELECT 'u' || file_id || '.lab' AS k, count(*) AS n FROM fx_words GROUP BY 1) ON k = 'u' || c_custkey || '.lab'", "customer", "fx_words")
def _(customer, words):
    found = words.groupBy(F.concat(F.lit("u"), F.col("file_id").cast("string"), F.lit(".lab")).alias("file")).agg(F.count("*").alias("n"))
    meta = customer.select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("name"))
    return J.attach_alignments(meta, found, "name", "file", ".lab").select("c_custkey", "n")


@add("j9_first_match_phonetics", "WITH l AS (SELECT word, min_by(phones, alt_idx) AS phones FROM fx_lexicon GROUP BY 1) SELECT doc_id AS file_id, string_agg(coalesce(phones, ''), ' ' ORDER BY pos) AS phonetics FROM fx_tokens t LEFT JOIN l ON l.word = t.word GROUP BY 1", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    told = tokens.groupBy("word").agg(F.count("*").alias("n")).join(W.first_per_key(lexicon, ["word"], ["alt_idx"]), "word", "left")
    parts = tasks_for(tokens)
    rows = join_frequent(tokens, kept(told), ["word"], parts=parts)
    return J.sentence_phonetics(rows.select(F.col("doc_id").alias("file_id"), F.col("pos").alias("word_idx"), "word", "phones", "alt_idx"), ["alt_idx"], parts)


@add("j12_pair_labels", f"WITH a AS (SELECT l_orderkey AS rec, q FROM ({_ORDER})), b AS (SELECT o_orderkey AS rec, list_transform(range(o_orderkey % 4 + 1), lambda i: i * 3) AS d FROM orders) SELECT a.rec, array_to_string(q, ',') AS truth, array_to_string(d, ',') AS found FROM a JOIN b ON a.rec = b.rec AND len(q) = len(d)", "lineitem", "orders")
def _(lineitem, orders):
    truth = _order_lists(lineitem).select(F.col("l_orderkey").alias("rec"), F.col("q").alias("truth"))
    found = orders.select(F.col("o_orderkey").alias("rec"), F.transform(F.sequence(F.lit(0), F.col("o_orderkey") % 4), lambda i: i * 3).alias("found"))
    out = J.pair_labels(truth, found, "rec")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("rec", text("truth"), text("found"))


@add("k25_explode_operator", "SELECT rec_id, CAST(frame_idx AS BIGINT) AS frame_idx, t AS step, p FROM (SELECT rec_id, frame_idx, CAST(unnest(range(10)) AS BIGINT) AS t, unnest(probs) AS p FROM fx_frames)", "fx_frames")
def _(frames):
    return K.explode_sequences(frames, ["rec_id", "frame_idx"], "probs", "step", "p").select("rec_id", _long("frame_idx"), _long("step"), "p")


@add("a2_token_error_rate", "SELECT word, round(CASE WHEN n > 1 THEN 1.0 / greatest(len(string_split(x, '_')), len(string_split(y, '_'))) ELSE 0.0 END, 6) AS rate FROM (SELECT word, count(DISTINCT phones) AS n, min_by(phones, alt_idx) AS x, max_by(phones, alt_idx) AS y FROM fx_lexicon GROUP BY 1)", "fx_lexicon")
def _(lexicon):
    both = lexicon.groupBy("word").agg(F.split(F.min_by("phones", "alt_idx"), "_").alias("x"), F.split(F.max_by("phones", "alt_idx"), "_").alias("y"))
    return both.select("word", F.round(K.token_error_rate(F.col("x"), F.col("y")), 6).alias("rate"))


@add("k2_knn_uniform", "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 500), d AS (SELECT a.vec_id AS id, t.label, t.vec_id AS tid, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS d FROM embeddings a, t), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tid) AS r FROM d) SELECT id, label, round(count(*) / 10.0, 6) AS p FROM n WHERE r <= 10 GROUP BY 1, 2", "embeddings")
def _(embeddings):
    rows = embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    out = knn_probabilities(W.cap_per_class(rows, "label", "id", 500), rows.select("id", "v"), 10, weights="uniform")
    return out.withColumn("p", F.round("p", 6))
