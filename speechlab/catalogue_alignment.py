"""Queries on selections, alignments, transcripts and programs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechlab.functions import phonetics as P
from speechlab.operators import alignment as A
from speechlab.operators import selection as E
from speechlab.operators import windows as W
from speechlab.plans.registry import add

_ALT0 = "fx_lexicon WHERE alt_idx = 0"


def _long(col: str):
    return F.col(col).cast("long").alias(col)


def _r(col: str):
    return F.round(F.col(col), 6).alias(col)


def _first(lexicon):
    return lexicon.where("alt_idx = 0").select("word", "phones")


# selections
@add("e1_words_with_phone", f"SELECT word, phones FROM {_ALT0} AND list_contains(string_split(phones, '_'), 'K') ORDER BY md5(word || '-focus'), word LIMIT 40", "fx_lexicon")
def _(lexicon):
    return E.words_with_phone(_first(lexicon), "K", 40, "focus")


@add("e2_phone_strength", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, len(list_filter(string_split(phones, '_'), lambda p: regexp_matches(p, '^IH|^EH1'))) AS strength FROM fx_lexicon WHERE regexp_matches(phones, '(^|_)(IH|EH1)')", "fx_lexicon")
def _(lexicon):
    return E.phone_strength(lexicon, ["^IH", "^EH1"]).select("word", _long("alt_idx"), "strength")


@add("e3_two_syllables", f"SELECT word FROM {_ALT0} AND len(regexp_extract_all(phones, '[012]')) >= 2 ORDER BY md5(word || '-two'), word LIMIT 50", "fx_lexicon")
def _(lexicon):
    return W.sample_n(_first(lexicon).where(F.regexp_count("phones", F.lit("[012]")) >= 2).select("word"), "word", 50, "two")


@add("e4_stress_groups", f"WITH w AS (SELECT word, regexp_replace(phones, '[^012]', '', 'g') AS pattern FROM {_ALT0}) SELECT word, length(pattern) AS n_syll, pattern, count(*) OVER (PARTITION BY pattern) AS n_words FROM w", "fx_lexicon")
def _(lexicon):
    return E.stress_groups(_first(lexicon))


@add("e6_contrast_pairs", "WITH m AS (SELECT word, bool_or(regexp_matches(phones, 'IH')) AS o, bool_or(regexp_matches(phones, 'AE')) AS t FROM fx_lexicon GROUP BY 1), p AS (SELECT word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM fx_tokens) SELECT DISTINCT a, b FROM p JOIN m x ON x.word = a JOIN m y ON y.word = b WHERE (x.o AND y.t) OR (x.t AND y.o)", "fx_neighbours", "fx_lexicon")
def _(neighbours, lexicon):
    pairs = neighbours.select(F.col("word").alias("a"), F.col("next").alias("b")).distinct()
    return E.contrast_pairs(pairs, lexicon, "IH", "AE")


_E7 = "SELECT word, row_number() OVER (ORDER BY md5(word || '-odd'), word) - 1 AS r FROM fx_lexicon WHERE alt_idx = 0 AND regexp_matches(phones, '{}') AND NOT regexp_matches(phones, '{}')"


@add("e7_odd_one_out", f"WITH a AS ({_E7.format('IH', 'AE')}), b AS ({_E7.format('AE', 'IH')}) SELECT a.word AS odd, x.word AS \"first\", y.word AS second FROM a JOIN b x ON x.r = 2 * a.r JOIN b y ON y.r = 2 * a.r + 1 WHERE a.r < 12", "fx_lexicon")
def _(lexicon):
    return E.odd_one_out(_first(lexicon), "IH", "AE", 12, "odd")


@add("f8_voicing_rule", f"WITH w AS (SELECT regexp_extract(phones, '[A-Z]+[0-2]?$', 0) AS phone FROM {_ALT0}) SELECT phone, CASE WHEN phone IN ('T', 'D') THEN 'IH0_D' WHEN phone IN ('P', 'K', 'F', 'S', 'SH', 'CH', 'TH') THEN 'T' ELSE 'D' END AS ending, count(*) AS n FROM w GROUP BY 1, 2", "fx_lexicon")
def _(lexicon):
    last = F.element_at(F.split("phones", "_"), -1)
    return _first(lexicon).groupBy(last.alias("phone")).agg(F.count("*").alias("n")).withColumn("ending", E.voicing_rule(F.col("phone")))


# alignments
@add("a1_global_alignment", "WITH t AS (SELECT word, min_by(phones, alt_idx) AS x, max_by(phones, alt_idx) AS y FROM fx_lexicon GROUP BY 1) SELECT word, CAST(len(string_split(x, '_')) AS INT) AS n_match, CASE WHEN x = y THEN replace(x, '_', ' ') ELSE regexp_replace(replace(x, '_', ' '), ' ', ' - ') END AS a, replace(y, '_', ' ') AS b FROM t", "fx_lexicon")
def _(lexicon):
    both = lexicon.groupBy("word").agg(F.min_by("phones", "alt_idx").alias("x"), F.max_by("phones", "alt_idx").alias("y"))
    got = both.select("word", A.align(F.split("x", "_"), F.split("y", "_")).alias("z"))
    return got.select("word", F.col("z.n_match").alias("n_match"), F.array_join("z.a", " ").alias("a"), F.array_join("z.b", " ").alias("b"))


@add("w19_equal_split", 'WITH f AS (SELECT *, CAST(lag(phone) OVER w IS DISTINCT FROM phone AS INT) AS new FROM fx_phone_intervals WINDOW w AS (PARTITION BY file_id ORDER BY start, word_id, k)), g AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id, k) AS run FROM f), h AS (SELECT *, min(start) OVER r AS lo, max("end") OVER r AS hi, count(*) OVER r AS n, row_number() OVER (PARTITION BY file_id, run ORDER BY start, word_id, k) - 1 AS i FROM g WINDOW r AS (PARTITION BY file_id, run)) SELECT file_id, word_id, CAST(k AS BIGINT) AS k, phone, floor((lo + i * ((hi - lo) / n)) * 100 + 0.5) / 100 AS start, floor((lo + (i + 1) * ((hi - lo) / n)) * 100 + 0.5) / 100 AS "end" FROM h', "fx_phone_intervals")
def _(phones):
    kept = phones.withColumn("at", F.col("start"))
    return A.equal_split(kept, ["file_id"], ["at", "word_id", "k"]).select("file_id", "word_id", _long("k"), "phone", "start", "end")


@add("w6_assign_lines", "SELECT doc_id, pos, word, pos // 8 AS line FROM fx_tokens", "fx_tokens")
def _(tokens):
    lines = tokens.groupBy("doc_id", F.expr("cast(pos div 8 as bigint)").alias("line")).agg(F.array_join(F.collect_list("word"), "").alias("letters"))
    return A.assign_lines(tokens, lines, ["doc_id"], "pos", "line").select("doc_id", _long("pos"), "word", "line")


@add("w7_cut_table", 'SELECT c.c_custkey AS file_id, min(w.start) AS start, max(w."end") AS "end", round(avg(CASE WHEN w.word IS NULL THEN NULL WHEN w.word = \'error\' THEN 1.0 ELSE 0.0 END), 6) AS mismatch, count(w.file_id) > 0 AS detected FROM customer c LEFT JOIN fx_words w ON w.file_id = c.c_custkey GROUP BY 1', "fx_words", "customer")
def _(words, customer):
    return A.cut_table(words, customer.select(F.col("c_custkey").alias("file_id")), ["file_id"], "error").withColumn("mismatch", F.round("mismatch", 6))


_W9 = "SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1"


@add("w9_chunk_groups", f"SELECT l_orderkey, list_sum(q[1:2]) AS a, coalesce(list_sum(q[3:3]), 0) AS b, coalesce(list_sum(q[4:]), 0) AS c FROM ({_W9})", "lineitem")
def _(lineitem):
    rows = lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))), lambda x: x["q"]).alias("q"))
    groups = rows.select("l_orderkey", A.chunk_groups(F.col("q"), F.array(F.lit(2), F.lit(1), F.greatest(F.size("q") - 3, F.lit(0)))).alias("g"))

    def total(i):
        return F.aggregate(F.get("g", F.lit(i)), F.lit(0).cast("long"), lambda s, x: s + x)

    return groups.select("l_orderkey", total(0).alias("a"), total(1).alias("b"), total(2).alias("c"))


# lexicon
_PARTS = "WITH p AS (SELECT word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM fx_tokens), d AS (SELECT DISTINCT a, b FROM p WHERE b IS NOT NULL)"


@add("x12_compounds", f"{_PARTS} SELECT a || '-' || b AS word, row_number() OVER (PARTITION BY a, b ORDER BY x.alt_idx, y.alt_idx) - 1 AS alt_idx, x.phones || '_' || y.phones AS phones FROM d JOIN fx_lexicon x ON x.word = a JOIN fx_lexicon y ON y.word = b", "fx_neighbours", "fx_lexicon")
def _(neighbours, lexicon):
    pairs = neighbours.select(F.col("word").alias("a"), F.col("next").alias("b")).where("b is not null").distinct()
    known = lexicon.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "phones"))), lambda x: x["phones"]).alias("alternatives"))
    both = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    whole = A.compounds(both.select("a", "b", F.posexplode(F.array("x", "y")).alias("i", "alternatives")), ["a", "b"], "i")
    return whole.select(F.concat_ws("-", "a", "b").alias("word"), _long("alt_idx"), "phones")


@add("x13_spelled_acronyms", "WITH w AS (SELECT DISTINCT word FROM fx_tokens), l AS (SELECT word, unnest(range(length(word))) AS i FROM w), n AS (SELECT l.word, i, CASE WHEN p.letter IN ('b', 'd', 'g', 'p', 't') THEN p.phone || '_IH1' ELSE p.phone END AS name FROM l LEFT JOIN fx_letter_phone p ON p.letter = substring(l.word, CAST(i + 1 AS INT), 1)) SELECT word, string_agg(name, '_' ORDER BY i) AS phones FROM n GROUP BY 1 HAVING count(*) = count(name)", "fx_tokens", "fx_letter_phone")
def _(tokens, names):
    first = names.select("letter", F.lit(0).alias("alt_idx"), F.col("phone").alias("phones"))
    more = names.where(F.col("letter").isin("b", "d", "g", "p", "t")).select("letter", F.lit(1).alias("alt_idx"), F.concat("phone", F.lit("_IH1")).alias("phones"))
    return A.spelled(tokens, first.unionByName(more))


@add("x14_longest_alternative", "SELECT word, phones FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY len(string_split(phones, '_')) DESC, alt_idx) AS r FROM fx_lexicon) WHERE r = 1", "fx_lexicon")
def _(lexicon):
    return W.first_per_key(lexicon, ["word"], [F.size(F.split("phones", "_")).desc(), "alt_idx"]).select("word", "phones")


@add("x19_first_mismatch", f"WITH m AS (SELECT t.doc_id, t.pos, t.word, l.phones FROM fx_tokens t JOIN fx_lexicon l ON l.word = t.word AND l.alt_idx = 1 WHERE len(regexp_extract_all(t.word, '[aeiou]')) <> len(regexp_extract_all(l.phones, '[012]'))) SELECT doc_id, count(*) AS n, min_by(word, pos) AS word, min_by(phones, pos) AS phones FROM m GROUP BY 1", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    known = tokens.join(lexicon.where("alt_idx = 1"), "word")
    bad = known.where(F.regexp_count("word", F.lit("[aeiou]")) != F.regexp_count("phones", F.lit("[012]")))
    return bad.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("word", "pos").alias("word"), F.min_by("phones", "pos").alias("phones"))


# joins
@add("j3_aligned_metadata", "SELECT c_custkey, c_name, count(*) AS n_words FROM customer JOIN fx_words ON 'u' || file_id || '.lab' = 'u' || c_custkey || '.lab' GROUP BY 1, 2", "customer", "fx_words")
def _(customer, words):
    found = words.groupBy(F.concat(F.lit("u"), F.col("file_id").cast("string"), F.lit(".lab")).alias("key")).agg(F.count("*").alias("n_words"))
    return customer.withColumn("key", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit(".lab"))).join(found, "key").select("c_custkey", "c_name", "n_words")


@add("j9_sentence_phonetics", "WITH l AS (SELECT word, min_by(phones, alt_idx) AS phones FROM fx_lexicon GROUP BY 1) SELECT doc_id, count(*) AS n, string_agg(phones, ' ' ORDER BY pos) AS phonetics FROM fx_tokens t JOIN l ON l.word = t.word GROUP BY 1", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    first = W.first_per_key(lexicon, ["word"], ["alt_idx"]).select("word", "phones")
    rows = tokens.join(first, "word").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "phones"))).alias("p"))
    return rows.select("doc_id", "n", F.array_join(F.transform("p", lambda x: x["phones"]), " ").alias("phonetics"))


@add("j12_equal_length", "WITH a AS (SELECT l_orderkey AS rec, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS t FROM lineitem GROUP BY 1), b AS (SELECT rec // 10 AS rec, list(detection ORDER BY rec, detection) AS d FROM fx_detect WHERE detection <> 'R' GROUP BY 1) SELECT a.rec, array_to_string(t, '') AS truth, array_to_string(d, '') AS found FROM a JOIN b ON a.rec = b.rec AND len(t) = len(d)", "lineitem", "fx_detect")
def _(lineitem, detect):
    truth = lineitem.groupBy(F.col("l_orderkey").alias("rec")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("t"))
    kept = detect.where("detection <> 'R'").select(F.expr("cast(rec div 10 as bigint)").alias("o"), "rec", "detection")
    found = kept.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("rec", "detection"))), lambda x: x["detection"]).alias("d")).withColumnRenamed("o", "rec")
    return truth.join(found, "rec").where(F.size("t") == F.size("d")).select("rec", F.array_join("t", "").alias("truth"), F.array_join("d", "").alias("found"))


# reports
@add("g15_stress_error_by_length", "WITH w AS (SELECT word, regexp_replace(phonetics, '[^012]', '', 'g') AS s FROM fx_phon), e AS (SELECT word, length(s) AS n_syll, unnest(range(length(s))) AS i, s FROM w WHERE contains(s, '0')) SELECT n_syll, count(*) AS n, round(avg(CASE WHEN (substring(s, CAST(i + 1 AS INT), 1) = '1') <> (length(word) % n_syll = i) THEN 1.0 ELSE 0.0 END), 6) AS error FROM e GROUP BY 1", "fx_phon")
def _(phon):
    bits = phon.select("word", P.stress_bits(P.phones(F.col("phonetics"))).alias("truth")).where(F.array_contains("truth", 0))
    both = bits.withColumn("guess", F.transform("truth", lambda x, i: (F.length("word") % F.size("truth") == i).cast("int")))
    wrong = both.select(F.size("truth").cast("long").alias("n_syll"), F.explode(F.zip_with("truth", "guess", lambda x, y: (x != y).cast("double"))).alias("bad"))
    return wrong.groupBy("n_syll").agg(F.count("*").alias("n"), F.round(F.avg("bad"), 6).alias("error"))


@add("k7_accuracy_without_stress", "WITH g AS (SELECT phone, unnest([0, 1]) AS model, pos FROM fx_phones_of_word), d AS (SELECT model, phone, CASE WHEN model = 0 THEN replace(phone, '1', '0') WHEN pos = 0 THEN 'K' ELSE phone END AS guess FROM g) SELECT CAST(model AS BIGINT) AS model, round(avg(CASE WHEN phone = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN regexp_replace(phone, '[012]$', '') = regexp_replace(guess, '[012]$', '') THEN 1.0 ELSE 0.0 END), 6) AS accuracy_unstressed FROM d GROUP BY 1", "fx_phones_of_word")
def _(phones):
    guess = F.when(F.col("model") == 0, F.regexp_replace("phone", "1", "0")).when(F.col("pos") == 0, "K").otherwise(F.col("phone"))
    rows = phones.select("phone", "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("model")).withColumn("guess", guess)
    equal = P.unstress(F.col("phone")) == P.unstress(F.col("guess"))
    return rows.groupBy(_long("model")).agg(F.round(F.avg((F.col("phone") == F.col("guess")).cast("double")), 6).alias("accuracy"), F.round(F.avg(equal.cast("double")), 6).alias("accuracy_unstressed"))




_WHOLE = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))"


# every row is a training row, in groups; a row's vector read backwards is told from them
@add("k2_knn_probabilities", "WITH d AS (SELECT a.vec_id AS id, t.label, t.vec_id AS tid, list_distance(list_reverse(CAST(a.embedding AS DOUBLE[])), CAST(t.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings t), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tid) AS r FROM d), k AS (SELECT *, bool_or(d = 0) OVER (PARTITION BY id) AS exact FROM n WHERE r <= 10), v AS (SELECT id, label, sum(CASE WHEN exact THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END) AS w FROM k GROUP BY 1, 2) SELECT id, label, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM v WHERE w > 0", "embeddings")
def _(embeddings):
    rows = embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return A.knn_probabilities(rows, rows.select("id", F.reverse("v").alias("v")), 10, most_training=0).withColumn("p", F.round("p", 6))


# a capped balanced set
@add("k2_knn_probabilities_whole", f"WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 500), d AS (SELECT a.vec_id AS id, t.label, t.vec_id AS tid, {_WHOLE} AS d FROM embeddings a, t), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tid) AS r FROM d), k AS (SELECT *, bool_or(d = 0) OVER (PARTITION BY id) AS exact FROM n WHERE r <= 10), v AS (SELECT id, label, sum(CASE WHEN exact THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END) AS w FROM k GROUP BY 1, 2) SELECT id, label, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM v WHERE w > 0", "embeddings")
def _(embeddings):
    rows = embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return A.knn_probabilities(W.cap_per_class(rows, "label", "id", 500), rows.select("id", "v"), 10).withColumn("p", F.round("p", 6))


@add("k17_unstressed_verdict", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, 100 - CAST(l_quantity AS BIGINT) AS s, l_returnflag = 'N' AS hit FROM lineitem), t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM r) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, (n = 1 OR k <= ceil(n / 3.0)) AND hit AS unstressed FROM t", "lineitem")
def _(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (100 - F.col("l_quantity").cast("long")).alias("s"), (F.col("l_returnflag") == "N").alias("hit"), F.struct("l_linenumber", "l_partkey").alias("o"))
    return W.top_binary(rows, ["l_orderkey"], "s", "o", 3, 0.0).select("l_orderkey", _long("l_linenumber"), "l_partkey", ((F.col("bit") == 1) & F.col("hit")).alias("unstressed"))


# programs
@add("n1_n2_program", "SELECT o_custkey, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey", "orders", "lineitem")
def _(orders, lineitem):
    inner = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(_long("l_linenumber"), "l_returnflag"))).alias("lines"))
    nested = orders.select("o_custkey", "o_orderkey").join(inner, "o_orderkey", "left").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "lines"))).alias("orders"))
    flat = nested.select("o_custkey", F.explode_outer("orders").alias("o")).select("o_custkey", "o.o_orderkey", F.explode_outer("o.lines").alias("l"))
    return flat.select("o_custkey", "o_orderkey", "l.l_linenumber", "l.l_returnflag")


@add("n3_n4_phrase_maps", "SELECT l_orderkey, k, v, count(*) AS n FROM (SELECT l_orderkey, unnest(['flag', 'status']) AS k, unnest([l_returnflag, l_linestatus]) AS v FROM lineitem) WHERE v <> 'N' GROUP BY 1, 2, 3", "lineitem")
def _(lineitem):
    maps = lineitem.select("l_orderkey", F.create_map(F.lit(" Flag"), F.concat("l_returnflag", F.lit(" ")), F.lit("Status "), F.col("l_linestatus"), F.lit("id"), F.col("l_linenumber").cast("string")).alias("m"))
    clean = F.transform_values(F.transform_keys("m", lambda k, v: F.lower(F.trim(k))), lambda k, v: F.trim(v))
    kept = F.map_filter(clean, lambda k, v: (k != "id") & (v != "N"))
    return maps.select("l_orderkey", F.explode(kept).alias("k", "v")).groupBy("l_orderkey", "k", "v").agg(F.count("*").alias("n"))


@add("n5_filename_parts", "SELECT event_id, CAST(user_id AS VARCHAR) AS speaker, event_type AS task, CASE event_id % 2 WHEN 0 THEN 'control' ELSE 'patient' END AS kind FROM events", "events")
def _(events):
    name = F.concat_ws("__", F.col("user_id").cast("string"), "event_type", F.concat(F.lit("P"), (F.col("event_id") % 2).cast("string")))
    part = F.split(name, "__")
    return events.select("event_id", part[0].alias("speaker"), part[1].alias("task"), F.when(part[2] == "P0", "control").when(part[2] == "P1", "patient").alias("kind"))
