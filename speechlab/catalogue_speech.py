"""Queries on lexicons, selections, verdicts and frame tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.functions import phonetics as P
from speechlab.operators import frames as K
from speechlab.operators import lexicon as X
from speechlab.operators import metrics as G
from speechlab.operators import selection as E
from speechlab.operators import windows as W
from speechlab.plans.registry import add

ALPHABET = ["AE0", "AE1", "AH0", "B", "D", "EH0", "EH1", "F", "G", "HH", "IH0", "IH1", "JH", "K", "L", "M", "N", "OW0", "OW1", "P", "R", "S", "T", "UH0", "UH1", "V", "W", "Y", "Z"]
_LIST = "[" + ", ".join(f"'{p}'" for p in ALPHABET) + "]"
_FLAT = "string_split_regex(phonetics, '[ |_]')"


def _r(col: str):
    return F.round(F.col(col), 6).alias(col)


def _long(col: str):
    return F.col(col).cast("long").alias(col)


# text and phones
@add("t20_clean_word_list", "SELECT doc_id, pos, word FROM fx_tokens WHERE word IN (SELECT word FROM fx_lexicon)", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    lines = tokens.select("doc_id", _long("pos"), F.concat(F.col("pos").cast("string"), F.lit(". "), F.upper("word")).alias("line"))
    return E.clean_word_list(lines, "line", lexicon).select("doc_id", "pos", "word")


@add("p8_invalid_phone", f"SELECT word, list_filter(list_transform({_FLAT}, lambda p: regexp_replace(p, '[012]$', '')), lambda p: NOT list_contains(['AE', 'EH', 'IH', 'OW', 'UH', 'B', 'D', 'N', 'R', 'T'], p))[1] AS bad FROM fx_phon", "fx_phon")
def _(phon):
    return phon.select("word", P.invalid_phone(P.phones(F.col("phonetics")), ["AE", "EH", "IH", "OW", "UH", "B", "D", "N", "R", "T"]).alias("bad"))


@add("p19_n_vowels", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, len(list_filter(string_split(phones, '_'), lambda p: regexp_matches(p, '[012]$'))) AS n_vowels FROM fx_lexicon", "fx_lexicon")
def _(lexicon):
    return X.vowel_counts(lexicon).select("word", _long("alt_idx"), "n_vowels")


@add("p22_phone_categories", "SELECT CASE WHEN regexp_matches(phone, '[012]$') THEN 'vowel' WHEN phone IN ('L', 'R', 'W', 'Y') THEN 'approximant' WHEN phone IN ('M', 'N', 'NG') THEN 'nasal' WHEN phone IN ('CH', 'JH') THEN 'affricate' WHEN phone IN ('B', 'D', 'G', 'K', 'P', 'T') THEN 'stop' ELSE 'fricative' END AS category, count(*) AS n FROM fx_phones_of_word GROUP BY 1", "fx_phones_of_word")
def _(phones):
    return phones.groupBy(P.category(F.col("phone")).alias("category")).agg(F.count("*").alias("n"))


@add("p23_clusters", "WITH v AS (SELECT word, syl_idx, min(pos) AS v FROM fx_phones_of_word WHERE regexp_matches(phone, '[012]$') GROUP BY 1, 2) SELECT p.word, CAST(p.syl_idx AS BIGINT) AS syl_idx, coalesce(string_agg(phone, '_' ORDER BY pos) FILTER (pos < v), '') AS onset, coalesce(string_agg(phone, '_' ORDER BY pos) FILTER (pos > v), '') AS coda FROM fx_phones_of_word p JOIN v ON p.word = v.word AND p.syl_idx = v.syl_idx WHERE pos <> v GROUP BY 1, 2", "fx_phones_of_word")
def _(phones):
    return P.clusters(phones, ["word", "syl_idx"]).select("word", _long("syl_idx"), "onset", "coda")


@add("p25_phone_ids", "SELECT phone, row_number() OVER (ORDER BY phone) - 1 AS id, chr(CAST(32 + row_number() OVER (ORDER BY phone) AS INT)) AS code FROM (SELECT DISTINCT unnest(string_split(phones, '_')) AS phone FROM fx_lexicon)", "fx_lexicon")
def _(lexicon):
    return P.phone_ids(X.phone_inventory(lexicon))


@add("a2_token_distance", f"SELECT word, levenshtein(list_aggregate(list_transform(string_split(a.phones, '_'), lambda p: chr(CAST(33 + list_position({_LIST}, p) AS INT))), 'string_agg', ''), list_aggregate(list_transform(string_split(b.phones, '_'), lambda p: chr(CAST(33 + list_position({_LIST}, p) AS INT))), 'string_agg', '')) AS distance FROM (SELECT * FROM fx_lexicon WHERE alt_idx = 0) a JOIN (SELECT word, phones FROM fx_lexicon WHERE alt_idx = 1) b USING (word)", "fx_lexicon")
def _(lexicon):
    a = lexicon.where("alt_idx = 0").select("word", F.split("phones", "_").alias("a"))
    b = lexicon.where("alt_idx = 1").select("word", F.split("phones", "_").alias("b"))
    return a.join(b, "word").select("word", P.token_distance(F.col("a"), F.col("b"), ALPHABET).cast("long").alias("distance"))


# lexicon
@add("x3_derive_elisions", "SELECT p || word AS word, s || '_' || phones AS phones FROM fx_lexicon, (VALUES ('l''', 'L'), ('d''', 'D'), ('qu''', 'K')) AS t(p, s) WHERE alt_idx = 0 AND regexp_matches(phones, '^[A-Z]+[012](_|$)')", "fx_lexicon")
def _(lexicon):
    return X.derive_elisions(lexicon, [("l'", "L"), ("d'", "D"), ("qu'", "K")])


@add("x6_fix_rhotics", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, array_to_string(list_transform(x, lambda p, i: CASE WHEN p = 'R' AND i > 1 AND x[i - 1] IN ('OW0', 'OW1') AND (i = len(x) OR NOT regexp_matches(x[i + 1], '[012]$')) THEN 'ER0' ELSE p END), '_') AS phones FROM (SELECT word, alt_idx, string_split(phones, '_') AS x FROM fx_lexicon)", "fx_lexicon")
def _(lexicon):
    return X.fix_rhotics(lexicon, ["OW0", "OW1"]).select("word", _long("alt_idx"), "phones")


@add("x10_invert", "SELECT phones, string_agg(word, '|' ORDER BY word) AS words FROM fx_lexicon GROUP BY 1", "fx_lexicon")
def _(lexicon):
    return X.invert(lexicon, "phones", "word").select("phones", F.array_join("keys", "|").alias("words"))


@add("x15_stress_issues", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, n AS primaries, CAST(n > 1 AS BIGINT) + CAST(NOT regexp_matches(phones, '[01]') AS BIGINT) AS issues FROM (SELECT *, length(phones) - length(replace(phones, '1', '')) AS n FROM fx_lexicon)", "fx_lexicon")
def _(lexicon):
    return X.stress_issues(lexicon).select("word", _long("alt_idx"), "primaries", "issues")


@add("x16_choose_alternative", "WITH e AS (SELECT word, count(*) AS n_text FROM fx_syl GROUP BY 1), s AS (SELECT word, alt_idx, n_text = len(list_filter(string_split(phones, '_'), lambda p: regexp_matches(p, '[012]$'))) AND length(phones) - length(replace(phones, '1', '')) <= 1 AS good FROM fx_lexicon JOIN e USING (word)) SELECT word, CAST(coalesce(min(alt_idx) FILTER (good), 0) AS BIGINT) AS alt_idx, bool_or(good) AS matched FROM s GROUP BY 1", "fx_lexicon", "fx_syl")
def _(lexicon, syl):
    return X.choose_alternative(lexicon, syl.groupBy("word").agg(F.count("*").alias("n_text")))


_JOINED = "SELECT t.doc_id, t.pos, t.word, l.phones FROM fx_tokens t LEFT JOIN (SELECT word, phones FROM fx_lexicon WHERE alt_idx = 0) l ON l.word = t.word"


@add("x18_phonetize_ok", f"SELECT doc_id * 1000000 + pos // 2 AS doc_id, string_agg(phones, '|' ORDER BY pos) AS phonetics FROM ({_JOINED}) GROUP BY 1 HAVING bool_and(phones IS NOT NULL)", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    pairs = tokens.withColumn("doc_id", F.expr("doc_id * 1000000 + pos div 2"))  # utterances of two words
    return X.first_phones(pairs, lexicon)[0]


@add("x18_phonetize_errors", f"SELECT doc_id, CAST(min(pos) AS BIGINT) AS pos, arg_min(word, pos) AS word FROM ({_JOINED}) WHERE phones IS NULL GROUP BY 1", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return X.first_phones(tokens, lexicon)[1]


@add("x20_agreement_rate", "WITH e AS (SELECT word, count(*) AS n_text FROM fx_syl GROUP BY 1), v AS (SELECT word, len(list_filter(string_split(phones, '_'), lambda p: regexp_matches(p, '[012]$'))) AS n_phone FROM fx_lexicon WHERE alt_idx = 1) SELECT lang, round(100.0 * avg(CAST(n_text = n_phone AS DOUBLE)), 6) AS agreement, count(*) AS n FROM fx_tokens JOIN e USING (word) JOIN v USING (word) GROUP BY 1", "fx_tokens", "fx_syl", "fx_lexicon")
def _(tokens, syl, lexicon):
    text = tokens.join(syl.groupBy("word").agg(F.count("*").alias("n_text")), "word")
    spoken = X.vowel_counts(lexicon).where("alt_idx = 1").select("word", F.col("n_vowels").alias("n_phone"))
    return X.agreement(text, spoken, ["lang"]).select("lang", _r("agreement"), "n")


@add("x21_diff_versions", "SELECT string_split(b.phones, '_')[-1] AS ending, count(*) AS n FROM fx_lexicon a JOIN fx_lexicon b ON a.word = b.word AND a.alt_idx = 0 AND b.alt_idx = 1 WHERE a.phones <> b.phones GROUP BY 1", "fx_lexicon")
def _(lexicon):
    return X.diff_versions(lexicon.where("alt_idx = 0"), lexicon.where("alt_idx = 1"))


@add("x22_apply_filters", "SELECT word, phonetics FROM fx_phon WHERE starts_with(phonetics, 'D') AND NOT contains(phonetics, 'OW') AND contains(word, 'e')", "fx_phon")
def _(phon):
    return X.apply_filters(phon, [("phonetics", True, "startswith", "D"), ("phonetics", False, "contains", "OW"), ("word", True, "contains", "e")]).select("word", "phonetics")


@add("x23_variant_table", "SELECT word, phonetics AS stressed, regexp_replace(phonetics, '[012]', '', 'g') AS plain, replace(replace(phonetics, 'CH', 'T_SH'), 'JH', 'D_ZH') AS split, replace(phonetics, '|', '_') AS flat FROM fx_phon", "fx_phon")
def _(phon):
    c = F.col("phonetics")
    return phon.select("word", c.alias("stressed"), F.regexp_replace(c, "[012]", "").alias("plain"), P.split_affricates(c).alias("split"), F.array_join(P.phones(c), "_").alias("flat"))


# metrics
@add("g2_confusion", "SELECT target, " + ", ".join(f"coalesce(round(count(*) FILTER (detection = '{d}') / nullif(count(*) FILTER (detection IN ('A', 'N', 'R')), 0), 6), 0) AS share_{d.lower()}" for d in "ANR") + " FROM fx_detect GROUP BY 1", "fx_detect")
def _(detect):
    return G.confusion(detect, ["A", "N", "R"]).select("target", *[_r(f"share_{d}") for d in "anr"])


@add("g4_posterior_matrix", "WITH s AS (SELECT label, CAST(unnest(range(10)) AS BIGINT) AS phone, unnest(probs) AS p FROM fx_frames), t AS (SELECT label, phone, sum(p) AS s FROM s GROUP BY 1, 2) SELECT label, phone, round(s / sum(s) OVER (PARTITION BY label), 6) AS share FROM t", "fx_frames")
def _(frames):
    return G.posterior_matrix(frames, "label").select("label", _long("phone"), _r("share"))


# rounded to millionths in whole numbers
@add("g11_weighted_confidence", "SELECT l_orderkey, CAST((2 * 100 * sum(p * n) + sum(n)) // (2 * sum(n)) AS DOUBLE) / 1000000.0::DOUBLE AS confidence FROM (SELECT l_orderkey, CAST(round(l_discount * 10000) AS BIGINT) AS p, CAST(round(l_quantity * 100) AS BIGINT) AS n FROM lineitem) GROUP BY 1", "lineitem")
def _(lineitem):
    rows = lineitem.select("l_orderkey", F.round(F.col("l_discount") * 10000).cast("long").alias("p"), F.round(F.col("l_quantity") * 100).cast("long").alias("n"))
    out = G.weighted_confidence(rows, ["l_orderkey"], "p", "n")
    return out.select("l_orderkey", (F.expr("(200 * weighted + total) div (2 * total)").cast("double") / 1000000.0).alias("confidence"))


@add("g12_truth_stats", "SELECT rec_id, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(avg(hit), 6) AS match_rate FROM (SELECT rec_id, probs[CAST(label % 10 + 1 AS INT)] AS p, CAST(list_position(probs, list_max(probs)) - 1 = label % 10 AS INT) AS hit FROM fx_frames WHERE label % 10 <> 9) GROUP BY 1", "fx_frames")
def _(frames):
    return G.truth_stats(frames, F.col("label") % 10, 9).select("rec_id", _r("mean"), _r("median"), _r("match_rate"))


@add("g19_label_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1", "embeddings")
def _(embeddings):
    return G.label_counts(embeddings, "label")


@add("g22_rates_by_speaker", "SELECT string_split(url, '/')[-2] AS speaker, count(*) AS n, round(avg(CAST(contains(html, '<p>') AS DOUBLE)), 6) AS rate FROM pages GROUP BY 1", "pages")
def _(pages):
    return G.rates_by(pages, F.element_at(F.split("url", "/"), -2), F.col("html").contains("<p>")).select("speaker", "n", _r("rate"))


# windows, samples, selections
_ITEMS = "(SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS DOUBLE)) AS q, max(CAST(l_extendedprice AS DOUBLE)) AS e, max(CAST(l_discount AS DOUBLE)) AS d FROM lineitem GROUP BY 1, 2)"


def _items(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(F.col(c).cast("double")).alias(a) for a, c in (("q", "l_quantity"), ("e", "l_extendedprice"), ("d", "l_discount"))])


@add("w11_word_stress_bins", f"SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY e DESC, l_linenumber) = 1 AS INT) AS bit FROM {_ITEMS}", "lineitem")
def _(lineitem):
    return W.word_stress_bins(_items(lineitem), ["l_orderkey"], "e", "l_linenumber").select("l_orderkey", "l_linenumber", "bit")


_SCALED = "CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0.0 END"


@add("w13_stress_score", f"SELECT l_orderkey, l_linenumber, CAST(floor(round(({_SCALED.format('q')} * 1.0::DOUBLE + {_SCALED.format('e')} * 1.0::DOUBLE + {_SCALED.format('d')} * 0.5::DOUBLE) / 2.5::DOUBLE * 100, 6)) AS BIGINT) AS score FROM {_ITEMS} WINDOW w AS (PARTITION BY l_orderkey)", "lineitem")
def _(lineitem):
    return W.stress_score(_items(lineitem), ["l_orderkey"], {"q": 1.0, "e": 1.0, "d": 0.5}).select("l_orderkey", "l_linenumber", "score")


@add("w18_phrase_ids", "SELECT file_id, word_id, word || '_' || run || '_' || row_number() OVER (PARTITION BY file_id, run ORDER BY start, word_id) AS phrase_id FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id) AS BIGINT) AS run FROM (SELECT *, CAST(lag(word) OVER (PARTITION BY file_id ORDER BY start, word_id) IS DISTINCT FROM word AS INT) AS new FROM fx_words))", "fx_words")
def _(words):
    return W.phrase_ids(words, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "phrase_id")


@add("o1_sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-' || 'seed'), doc_id LIMIT 100", "documents")
def _(docs):
    return W.sample_n(docs.select("doc_id", "lang"), "doc_id", 100, "seed")


@add("o2_user_panel", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 50)) WHERE r <= 20", "events")
def _(events):
    return W.user_panel(events, "user_id", "event_id", 50, 20).select("user_id", "event_id")


@add("o6_dedupe", "SELECT text, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1", "documents")
def _(docs):
    return W.first_per_key(docs, ["text"], ["doc_id"]).select("text", "doc_id")


@add("f4_ending_class", "SELECT * FROM (SELECT word, CASE WHEN ends_with(word, 'ed') AND regexp_matches(phones, '_[A-Z]+0_D$') THEN 'ed:syllable' WHEN ends_with(word, 'ed') AND ends_with(phones, '_T') THEN 'ed:T' WHEN ends_with(word, 'ed') AND ends_with(phones, '_D') THEN 'ed:D' WHEN ends_with(word, 's') AND ends_with(phones, '_S') THEN 's:S' WHEN ends_with(word, 's') AND ends_with(phones, '_Z') THEN 's:Z' END AS class FROM fx_lexicon WHERE alt_idx = 0) WHERE class IS NOT NULL", "fx_lexicon")
def _(lexicon):
    return lexicon.where("alt_idx = 0").select("word", E.ending_class(F.col("word"), F.col("phones")).alias("class")).where("class is not null and class not like 'h:%'")


@add("f5_cluster_selection", "SELECT word, phonetics FROM fx_phon WHERE starts_with(phonetics, 'D_') ORDER BY md5(word || '-' || 'D_'), word LIMIT 20", "fx_phon")
def _(phon):
    return E.cluster_selection(phon, "phonetics", "D_", "start", 20, "word").select("word", "phonetics")


@add("f6_select_accent", "SELECT page_id FROM pages WHERE contains(string_split(url, '/')[-1], '1')", "pages")
def _(pages):
    return pages.where(E.select_accent(F.col("url"), "1", ("1", "2"))).select("page_id")


@add("f7_frequent_by_phone", "WITH c AS (SELECT word, count(*) AS n FROM fx_tokens GROUP BY 1), p AS (SELECT DISTINCT word, unnest(string_split(phones, '_')) AS phone FROM fx_lexicon WHERE alt_idx = 0), r AS (SELECT phone, word, row_number() OVER (PARTITION BY phone ORDER BY n DESC, word) AS rank FROM p JOIN c USING (word) WHERE phone IN ('D', 'N', 'T')) SELECT rank, max(word) FILTER (phone = 'D') AS \"D\", max(word) FILTER (phone = 'N') AS \"N\", max(word) FILTER (phone = 'T') AS \"T\" FROM r WHERE rank <= 20 GROUP BY 1", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    words = tokens.groupBy("word").agg(F.count("*").alias("n")).join(lexicon.where("alt_idx = 0"), "word")
    return E.frequent_by_phone(words, ["D", "N", "T"], 20).withColumn("rank", _long("rank"))


@add("f9_inject_ending", "SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i = 3 THEN w || '_Z' ELSE w END), ' ') AS out FROM benchmark", "benchmark")
def _(items):
    return items.select("item_id", E.inject_ending(F.col("text"), F.lit(2), "_Z").alias("out"))


# frames and verdicts
@add("k3_complete_classes", "SELECT rec_id, frame_idx, array_to_string(list_concat(list_transform(probs[1:8], lambda p: CAST(CAST(round(p * 1000000) AS BIGINT) AS VARCHAR)), ['0', '0']), '|') AS micro FROM fx_frames", "fx_frames")
def _(frames):
    full = K.complete_classes(F.slice("probs", 1, 8), 10)
    return frames.select("rec_id", "frame_idx", F.array_join(F.transform(full, lambda p: F.round(p * 1000000).cast("long").cast("string")), "|").alias("micro"))


@add("k6_soft_vote", "SELECT rec_id, frame_idx, CAST(round((0.7::DOUBLE * probs[1] + 0.3::DOUBLE * probs[10]) * 10000000) AS BIGINT) AS first, CAST(round((0.7::DOUBLE * probs[10] + 0.3::DOUBLE * probs[1]) * 10000000) AS BIGINT) AS last FROM fx_frames", "fx_frames")
def _(frames):
    other = frames.withColumn("probs", F.reverse("probs"))
    out = K.soft_vote(frames, other, ["rec_id", "frame_idx"], 0.7)
    return out.select("rec_id", "frame_idx", F.round(F.get("probs", F.lit(0)) * 10000000).cast("long").alias("first"), F.round(F.element_at("probs", -1) * 10000000).cast("long").alias("last"))


@add("k10_with_silence", "SELECT rec_id, frame_idx, CASE WHEN probs[10] < list_max(probs) THEN CAST(label AS VARCHAR) ELSE '[SIL]' END AS label FROM fx_frames", "fx_frames")
def _(frames):
    kept = K.drop_silence(frames).select("rec_id", "frame_idx", F.col("label").cast("string").alias("label"))
    return K.with_silence(frames, kept)


@add("k12_segments", 'SELECT rec_id, frame_idx // 10 AS pos, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, round(min(frame_idx) * 0.02::DOUBLE, 6) AS start, round((max(frame_idx) + 1) * 0.02::DOUBLE, 6) AS "end", round(avg(list_max(probs)), 6) AS p FROM fx_frames GROUP BY 1, 2', "fx_frames")
def _(frames):
    out = K.segments(frames.withColumn("pos", F.expr("frame_idx div 10")), 0.02)
    return out.select("rec_id", _long("pos"), _long("first_frame"), _long("last_frame"), _r("start"), _r("end"), _r("p"))


@add("k14_phone_contrast", "SELECT rec_id, frame_idx, CASE WHEN probs[CAST(label % 9 + 1 AS INT)] > 0.2 THEN label % 9 WHEN list_max(probs[1:3]) > 0 THEN list_position(probs[1:3], list_max(probs[1:3])) - 1 ELSE list_position(probs, list_max(probs)) - 1 END AS phone FROM fx_frames", "fx_frames")
def _(frames):
    return frames.select("rec_id", "frame_idx", K.phone_contrast(F.col("probs"), F.col("label") % 9, [0, 1, 2], 0.2).alias("phone"))


@add("k15_accept_alternatives", "SELECT rec, target, CASE WHEN target = 'R' AND detection = 'N' THEN 'R' ELSE detection END AS detection FROM fx_detect", "fx_detect")
def _(detect):
    return K.accept_alternatives(detect, [("R", "N")]).select("rec", "target", "detection")


@add("k19_gate", "SELECT event_id, CASE WHEN value / 100 <= 0.5 THEN 'empty' WHEN event_type = 'view' THEN 'no sound' WHEN value < 100 THEN 'too quiet' WHEN (user_id % 60) / (value / 100 - 0.5) > 8 THEN 'too short' WHEN (user_id % 60) / (value / 100 - 0.5) < 1 AND user_id % 60 > 1 THEN 'too long' WHEN event_id % 7 = 0 THEN 'no pitch' ELSE 'success' END AS status FROM events", "events")
def _(events):
    pitch = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    status = K.gate(F.col("event_type") != "view", F.col("value"), F.col("value") / 100 - 0.5, F.col("user_id") % 60, pitch, quiet=100.0)
    return events.select("event_id", status.alias("status"))


@add("k22_validate", "SELECT l_orderkey, l_linenumber, coalesce(q / 50 < CASE WHEN l_linenumber = 1 THEN 0.85 ELSE 0.7 END, false) AS accepted FROM " + _ITEMS, "lineitem")
def _(lineitem):
    return _items(lineitem).select("l_orderkey", "l_linenumber", K.validate(F.col("q") / 50, F.col("l_linenumber")).alias("accepted"))


@add("k25_explode_sequences", "SELECT rec_id, frame_idx, CAST(unnest(range(10)) AS BIGINT) AS phone, unnest(probs) AS p FROM fx_frames", "fx_frames")
def _(frames):
    return frames.select("rec_id", "frame_idx", F.posexplode("probs").alias("phone", "p")).withColumn("phone", _long("phone"))


# further forms of rows above
_FORMS = "SELECT word || '''s' AS f, word, 'S' AS c FROM fx_phon UNION ALL SELECT word || '''d', word, 'D' FROM fx_phon"


@add("x2_derive_forms", f"WITH f AS ({_FORMS}), d AS (SELECT f.f AS word, alt_idx, phones || '_' || CASE WHEN c = 'D' THEN CASE WHEN regexp_matches(phones, '(^|_)(T|D)$') THEN 'AH0_D' ELSE 'D' END WHEN regexp_matches(phones, '(^|_)(S|Z)$') THEN 'IH0_Z' WHEN regexp_matches(phones, '(^|_)(K|P|T|F)$') THEN 'S' ELSE 'Z' END AS phones FROM f JOIN fx_lexicon l ON l.word = f.word) SELECT word, CAST(alt_idx AS INT) AS alt_idx, phones FROM d WHERE word <> 'de''s' UNION ALL SELECT 'de''s', 0, 'X'", "fx_lexicon")
def _(lexicon):
    forms = lexicon.select(F.explode(F.array(F.concat("word", F.lit("'s")), F.concat("word", F.lit("'d")))).alias("word"))
    endings = {"'s": [(("S", "Z"), "IH0_Z"), (("K", "P", "T", "F"), "S"), ((), "Z")], "'d": [(("T", "D"), "AH0_D"), ((), "D")]}
    fixed = lexicon.sparkSession.createDataFrame([("de's", 0, "X")], "word string, alt_idx int, phones string")
    return X.derive_forms(lexicon, forms, endings, fixed)


@add("x11_lookup_oov", "WITH w AS (SELECT DISTINCT word FROM fx_tokens), l AS (SELECT word, phones FROM fx_lexicon WHERE alt_idx = 0) SELECT w.word, coalesce(l.phones, CASE WHEN length(w.word) = 9 THEN 'OOV' END) AS phones, CASE WHEN l.phones IS NOT NULL THEN 'exact' WHEN length(w.word) = 9 THEN 'oov' ELSE 'none' END AS how FROM w LEFT JOIN l ON l.word = w.word", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    oov = tokens.where(F.length("word") == 9).select("word", F.lit("OOV").alias("phones"))
    return X.lookup(tokens, lexicon, lambda c: c, oov)


@add("x14_letter_names", "SELECT word AS letter, CAST(0 AS INT) AS alt_idx, CASE word WHEN 'a' THEN 'EY1' ELSE phones END AS phones FROM fx_lexicon WHERE length(word) = 1 AND alt_idx = 0 UNION ALL SELECT 'w', 0, 'D_AH1_B'", "fx_lexicon")
def _(lexicon):
    fixes = lexicon.sparkSession.createDataFrame([("a", 0, "EY1"), ("w", 0, "D_AH1_B")], "word string, alt_idx int, phones string")
    return X.letter_names(lexicon, fixes)


@add("x16_mismatch_kind", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, CASE WHEN n <> e AND p > 1 THEN 'n_syl+stress' WHEN n <> e THEN 'n_syl' WHEN p > 1 THEN 'stress' END AS kind FROM (SELECT word, alt_idx, len(regexp_extract_all(phones, '[012]')) AS n, length(word) // 2 AS e, len(regexp_extract_all(replace(phones, '0', CASE WHEN length(word) % 3 = 0 THEN '1' ELSE '0' END), '1')) AS p FROM fx_lexicon)", "fx_lexicon")
def _(lexicon):
    phones = F.replace("phones", F.lit("0"), F.when(F.length("word") % 3 == 0, "1").otherwise("0"))
    kind = X.mismatch_kind(F.regexp_count(phones, F.lit("[012]")), F.floor(F.length("word") / 2), F.regexp_count(phones, F.lit("1")), F.lit(1))
    return lexicon.select("word", _long("alt_idx"), kind.alias("kind"))


@add("x23_variant_join", "SELECT coalesce(a.word, b.word) AS word, a.phones AS first, b.phones AS second FROM (SELECT * FROM fx_lexicon WHERE alt_idx = 0 AND length(word) % 4 > 0) a FULL JOIN (SELECT * FROM fx_lexicon WHERE alt_idx = 1) b ON a.word = b.word", "fx_lexicon")
def _(lexicon):
    return X.variant_table([("first", lexicon.where("alt_idx = 0 and length(word) % 4 > 0")), ("second", lexicon.where("alt_idx = 1"))], "word", "phones")


@add("w8_segment_names", "SELECT file_id, word_id, word || '_' || row_number() OVER (PARTITION BY file_id, run ORDER BY start, word_id) - 1 || '.wav' AS name FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id) AS BIGINT) AS run FROM (SELECT *, CAST(lag(word) OVER (PARTITION BY file_id ORDER BY start, word_id) IS DISTINCT FROM word AS INT) AS new FROM fx_words))", "fx_words")
def _(words):
    rows = words.withColumn("word", F.concat(F.lit("a/"), "word", F.lit(".flac")))
    return W.segment_names(rows, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "name")


@add("f1_select_words_operator", "SELECT word, phonetics FROM fx_phon WHERE contains(phonetics, 'IH') AND starts_with(word, 'd')", "fx_phon")
def _(phon):
    return E.select_words(E.select_words(phon, "IH", "phonetics", "contains"), "d", "word", "startswith").select("word", "phonetics")


@add("f3_target_syllable_operator", "SELECT word, list_position(list_transform(string_split(phonetics, '|'), lambda s: list_contains(string_split(s, '_'), 'D')), true) - 1 AS syl FROM fx_phon WHERE list_contains(string_split_regex(phonetics, '[ |_]'), 'D')", "fx_phon")
def _(phon):
    return E.target_syllable(phon, "D").select("word", "syl")


@add("e3_polysyllables", "SELECT word FROM fx_lexicon WHERE alt_idx = 0 AND len(regexp_extract_all(phones, '[012]')) >= 3 ORDER BY md5(word || '-three'), word LIMIT 50", "fx_lexicon")
def _(lexicon):
    return E.polysyllables(lexicon.where("alt_idx = 0"), 50, "three", 3)


@add("g15_word_stress_operator", "WITH w AS (SELECT word, regexp_replace(phonetics, '[^012]', '', 'g') AS s FROM fx_phon), e AS (SELECT length(s) AS n_syll, unnest(range(length(s))) AS i, s, length(word) AS l FROM w WHERE (length(s) = 1 OR contains(s, '0'))) SELECT n_syll, count(*) AS n, round(avg(CASE WHEN (substring(s, CAST(i + 1 AS INT), 1) = '1') <> (l % n_syll = i) THEN 1.0 ELSE 0.0 END), 6) AS error FROM e GROUP BY 1", "fx_phon")
def _(phon):
    bits = phon.select("word", P.stress_bits(P.phones(F.col("phonetics"))).alias("truth"))
    found = bits.withColumn("found", F.transform("truth", lambda x, i: (F.length("word") % F.size("truth") == i).cast("int")))
    return G.word_stress_eval(found).select("n_syll", "n", _r("error"))


@add("g18_syllable_set_operator", "SELECT DISTINCT unnest(string_split(phonetics, '|')) AS syllable FROM fx_phon WHERE length(word) > 3", "fx_phon")
def _(phon):
    return G.syllable_set(phon.where("length(word) > 3"))


@add("k14_rewritten_syllable", "SELECT word, array_to_string(list_transform(string_split(string_split(phonetics, '|')[1], '_'), lambda p, i: regexp_replace(CASE WHEN i = 1 THEN 'K' ELSE p END, '[012]$', '')), '_') AS out FROM fx_phon", "fx_phon")
def _(phon):
    first = F.get(F.element_at(P.split_phonetics(F.col("phonetics")), 1), F.lit(0))
    return phon.select("word", F.array_join(K.rewritten_syllable(first, F.lit(0), F.lit("K")), "_").alias("out"))


@add("k7_classifier_scores", "SELECT CAST(pos % 2 AS BIGINT) AS model, round(avg(CASE WHEN phone = replace(phone, '1', '0') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN true THEN 1.0 ELSE 0.0 END), 6) AS accuracy_unstressed FROM fx_phones_of_word GROUP BY 1", "fx_phones_of_word")
def _(phones):
    rows = phones.select((F.col("pos") % 2).cast("long").alias("model"), "phone", F.regexp_replace("phone", "1", "0").alias("guess"))
    return G.classifier_scores(rows).select("model", _r("accuracy"), _r("accuracy_unstressed"))
