"""Every registered query of the library, with its DuckDB SQL.

Both sides read the given tables, or tables that both derive from them (``plans.fixtures``).
Arrays are joined to text, counts are long, measures are doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlab import catalogue_alignment, catalogue_evaluation, catalogue_files, catalogue_jobs, catalogue_pronunciation, catalogue_speech  # noqa: F401  (they register their queries)
from speechlab.functions import phonetics as P
from speechlab.functions import text as T
from speechlab.operators import frames as K
from speechlab.operators import joins as J
from speechlab.operators import lexicon as X
from speechlab.operators import metrics as G
from speechlab.operators import syllables as Y
from speechlab.operators import windows as W
from speechlab.plans.fixtures import duck, table
from speechlab.plans.registry import QUERIES as _QUERIES
from speechlab.plans.registry import SQL as _SQL
from speechlab.plans.registry import Query
from speechlab.plans.registry import add as _add
from speechlab.sources import files as S

def _joined(arr: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)


def _long(col: str) -> Column:
    return F.col(col).cast("long").alias(col)


def _r(col: str) -> Column:
    return F.round(F.col(col), 6).alias(col)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.syllables_per_word(table(spark, sf_dir, "fx_tokens"))


_QUERIES["g17_syllables_per_word"] = flagship


# text
def _text(name: str, column: Callable[[Column], Column], sql: str, source: str = "documents", keys: tuple[str, ...] = ("doc_id",)) -> None:
    _QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).select(*keys, column(F.col("text")).alias("out"))
    _SQL[name] = f"SELECT {', '.join(keys)}, {sql} AS out FROM {source}"


_TURN = ("conv_id", "turn")
_WS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
_text("t1_normalize_text", T.normalize_text, r"""trim(regexp_replace(lower(regexp_replace(replace(text, '’', ''''), '[,?.!¡;:"*{}]', '', 'g')), ' +', ' ', 'g'), ' ')""")
_text("t2_chunks", lambda c: _joined(T.chunks(c)), "array_to_string(list_filter(string_split_regex(text, '[,;.!¡?:/]'), lambda c: c <> ''), '|')", "conversations", _TURN)
_text("t3_chunk_word_counts", lambda c: _joined(T.chunk_word_counts(c)), f"array_to_string(list_transform(list_filter(string_split_regex(text, '[,;.!¡?:/]'), lambda c: c <> ''), lambda c: len({_WS.format('c')})), '|')", "conversations", _TURN)
_text("t4_glue_punctuation", T.glue_punctuation, r"regexp_replace(text, ' ([,?.!;:{}…])', '\1', 'g')")
_text("t8_edge_marks", lambda c: _joined(T.edge_marks(c)), f"array_to_string(list_filter(list_transform({_WS.format('text')}, lambda w, i: (i - 1) || ':' || regexp_extract(w, '^[,?.!;:]*') || '|' || regexp_extract(w, '[,?.!;:]*$')), lambda x: NOT ends_with(x, ':|')), '|')", "conversations", _TURN)
_text("t10_abbreviations", lambda c: T.expand_abbreviations(F.concat(c, F.lit(" Dr etc dr"))), "array_to_string(list_transform(string_split(text || ' Dr etc dr', ' '), lambda w: CASE w WHEN 'mr' THEN 'mister' WHEN 'mrs' THEN 'misses' WHEN 'dr' THEN 'docteur' WHEN 'Mr' THEN 'Mister' WHEN 'Mrs' THEN 'Misses' WHEN 'Dr' THEN 'Docteur' WHEN 'etc' THEN 'etcetera' ELSE w END), ' ')", "conversations", _TURN)
_text("t11_acronyms", lambda c: _joined(T.acronyms(c)), f"array_to_string(list_filter({_WS.format('text')}, lambda w: upper(w) = w AND lower(w) <> w), '|')", "conversations", _TURN)
_text("t13_ungroup", T.ungroup, "replace(replace(replace(text, '-', ' '), '{', ''), '}', '')")
_text("t15_fold_accents", T.fold_accents, f"translate(text, '{T.ACCENTED}', '{T.FOLDED}')")
_text("t17_end_with_period", T.end_with_period, "trim(text, ' ') || '.'", "benchmark", ("item_id",))
_text("t19_focus_bins", lambda c: _joined(T.focus_bins(c), ""), f"array_to_string(list_transform({_WS.format('text')}, lambda w: CAST(contains(w, '*') AS INT)), '')")
_text("t21_clean_letters", T.clean_letters, r"regexp_replace(text, '[0-9!-/:-@\[-`{-~»«♦•—¿·]', '', 'g')")


@_add("t18_vocabulary", f"SELECT DISTINCT word FROM (SELECT unnest({_WS.format('text')}) AS word FROM documents) WHERE NOT contains(word, '''')", "documents")
def _(docs):
    return T.vocabulary(docs)


@_add("s8_path_columns", "SELECT page_id, CASE WHEN len(p) > 2 THEN p[-3] END AS genre, CASE WHEN len(p) > 1 THEN p[-2] END AS speaker, p[-1] AS basename FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)", "pages")
def _(pages):
    return pages.select("page_id", *S.path_columns(F.col("url")))


@_add("s12_format_srt", """SELECT file_id, word_id, row_number() OVER (PARTITION BY file_id ORDER BY start, "end", text) || chr(10) || clock(start) || ' --> ' || clock("end") || chr(10) || text AS cue FROM (SELECT file_id, word_id, word AS text, start, "end" FROM fx_words)""".replace("clock(start)", "CLOCK_S").replace('clock("end")', "CLOCK_E").replace("CLOCK_S", "format('{:02d}:{:02d}:{:02d},{:03d}', CAST(round(start * 1000) AS BIGINT) // 3600000, CAST(round(start * 1000) AS BIGINT) // 60000 % 60, CAST(round(start * 1000) AS BIGINT) // 1000 % 60, CAST(round(start * 1000) AS BIGINT) % 1000)").replace("CLOCK_E", """format('{:02d}:{:02d}:{:02d},{:03d}', CAST(round("end" * 1000) AS BIGINT) // 3600000, CAST(round("end" * 1000) AS BIGINT) // 60000 % 60, CAST(round("end" * 1000) AS BIGINT) // 1000 % 60, CAST(round("end" * 1000) AS BIGINT) % 1000)"""), "fx_words")
def _(words):
    return S.format_srt(words.withColumnRenamed("word", "text"), ["file_id"]).select("file_id", "word_id", "cue")


# phonetics
def _phon(name: str, column: Callable[[], Column], sql: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, "fx_phon").select("word", column().alias("out"))
    _SQL[name] = duck(f"SELECT word, {sql} AS out FROM fx_phon")


_PH, _FLAT = "phonetics", "string_split_regex(phonetics, '[ |_]')"
_BITS = f"list_transform(list_filter({_FLAT}, lambda p: regexp_matches(p, '[012]$')), lambda p: CAST(ends_with(p, '1') AS INT))"
_phon("p1_split_phonetics", lambda: _joined(F.transform(F.flatten(P.split_phonetics(F.col(_PH))), lambda s: F.array_join(s, "+"))), "replace(phonetics, '_', '+')")
_phon("p2_split_by_word", lambda: F.size(F.element_at(P.split_by_word(F.col(_PH)), 1)).cast("long"), f"len({_FLAT})")
_phon("p3_phones", lambda: _joined(P.phones(F.col(_PH))), f"array_to_string({_FLAT}, '|')")
_phon("p4_n_syllables", lambda: P.n_syllables(F.col(_PH)).cast("long"), "len(string_split_regex(phonetics, '[ |]'))")
_phon("p6_unstress", lambda: _joined(F.transform(P.phones(F.col(_PH)), P.unstress)), f"array_to_string(list_transform({_FLAT}, lambda p: regexp_replace(p, '[012]$', '')), '|')")
_phon("p7_split_affricates", lambda: P.split_affricates(F.col(_PH)), "replace(replace(phonetics, 'CH', 'T_SH'), 'JH', 'D_ZH')")
_phon("p10_stress_bits", lambda: _joined(P.stress_bits(P.phones(F.col(_PH))), ""), f"array_to_string({_BITS}, '')")
_phon("p11_map_phones", lambda: _joined(P.map_phones(P.phones(F.col(_PH)), {"AE1": "æ", "B": "b", "IH0": "ɪ"})), f"array_to_string(list_transform({_FLAT}, lambda p: CASE p WHEN 'AE1' THEN 'æ' WHEN 'B' THEN 'b' WHEN 'IH0' THEN 'ɪ' ELSE p END), '|')")
_phon("p12_normalize_ending", lambda: _joined(P.normalize_ending(F.col("word"), F.transform(P.phones(F.col(_PH)), lambda p: F.replace(p, F.lit("EH0"), F.lit("AH0")))), "_"), "CASE WHEN ends_with(word, 'ed') AND ends_with(w, 'AH0_D') THEN regexp_replace(w, 'AH0_D$', 'IH0_D') WHEN ends_with(word, 'es') AND ends_with(w, 'AH0_Z') THEN regexp_replace(w, 'AH0_Z$', 'IH0_Z') ELSE w END".replace("(w,", "(replace(replace(phonetics, '|', '_'), 'EH0', 'AH0'),").replace("ELSE w", "ELSE replace(replace(phonetics, '|', '_'), 'EH0', 'AH0')"))
_phon("p13_collapse_runs", lambda: _joined(P.collapse_runs(F.transform(P.phones(F.col(_PH)), lambda p: p.rlike("[012]$").cast("string")))), f"(SELECT array_to_string(list_transform(list_filter(list_transform(x, lambda v, i: {{'v': v, 'i': i}}), lambda s: s.i = 1 OR s.v <> x[s.i - 1]), lambda s: s.v), '|') FROM (SELECT list_transform({_FLAT}, lambda p: CAST(regexp_matches(p, '[012]$') AS VARCHAR)) AS x))")
_phon("p15_stress_pattern", lambda: F.concat_ws(":", *[c.cast("string") for c in P.stress_pattern(P.phones(F.col(_PH)))]), f"len({_BITS}) || ':' || coalesce(list_position({_BITS}, 1), 0)")
_phon("p21_format_phonetics", lambda: P.format_phonetics(F.element_at(P.split_phonetics(F.col(_PH)), 1)), "phonetics")


@_add("p5_index_phones", "SELECT word, CAST(0 AS BIGINT) AS word_idx, CAST(syl_idx AS BIGINT) AS syl_idx, CAST(pos AS BIGINT) AS phone_idx, phone FROM fx_phones_of_word", "fx_phon")
def _(phon):
    out = P.index_phones(phon, "phonetics", "word")
    return out.select("word", _long("word_idx"), _long("syl_idx"), _long("phone_idx"), "phone")


_SON = "CASE WHEN contains('aeiouyàáâäæãåāèéêëēėęîïíīįìôöòóœøōõûüùúūůÿ', c) THEN 5 WHEN contains('lmnrw', c) THEN 3 WHEN contains('zvsfh', c) THEN 2 ELSE 0 END"
_SYLLABLES = f"""w AS (SELECT DISTINCT word FROM fx_tokens),
s AS (SELECT word, list_filter(string_split(word, ''), lambda c: c <> '') AS l FROM w),
t AS (SELECT word, l, list_transform(l, lambda c: {_SON}) AS son FROM s),
b AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR (i > 1 AND i < len(l) AND son[i] < son[i - 1] AND son[i] < son[i + 1]) OR (i > 2 AND son[i - 1] = son[i] AND son[i - 1] <= son[i - 2])) AS st FROM t),
p AS (SELECT *, list_filter(list_transform(st, lambda x, k: {{'a': x, 'e': coalesce(st[k + 1], len(l) + 1)}}), lambda z: list_contains(son[z.a : z.e - 1], 5)) AS p FROM b),
q AS (SELECT *, list_transform(p, lambda z, k: CASE WHEN k = 1 THEN 1 ELSE z.a END) AS q, len(list_filter(son, lambda x: x = 5)) AS n FROM p),
y AS (SELECT word, CASE n WHEN 0 THEN '' WHEN 1 THEN word ELSE array_to_string(list_transform(q, lambda x, k: array_to_string(l[x : coalesce(q[k + 1], len(l) + 1) - 1], '')), '|') END AS syllables FROM q)"""


@_add("y1_syllabify", f"WITH {_SYLLABLES} SELECT word, syllables FROM y", "fx_tokens")
def _(tokens):
    return Y.syllabify(tokens).select("word", F.array_join("syllables", "|").alias("syllables"))


@_add("y1_sonority", "SELECT word, array_to_string(list_transform(list_filter(string_split(word, ''), lambda x: x <> ''), lambda x: CASE WHEN contains('aeiouyàáâäæãåāèéêëēėęîïíīįìôöòóœøōõûüùúūůÿ', x) THEN 5 WHEN contains('lmnrw', x) THEN 3 WHEN contains('zvsfh', x) THEN 2 ELSE 0 END), '') AS son FROM (SELECT DISTINCT word FROM fx_tokens)", "fx_tokens")
def _(tokens):
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    return tokens.select("word").distinct().select("word", _joined(F.transform(letters, lambda x: Y.sonority(x)), "").alias("son"))


_SQL["g17_syllables_per_word"] = duck(f"WITH {_SYLLABLES} SELECT lang, CASE WHEN syllables = '' THEN 0 ELSE len(string_split(syllables, '|')) END AS n_syllables, count(*) AS n_words FROM fx_tokens JOIN y USING (word) GROUP BY 1, 2")


# lexicon
@_add("x1_override", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, phones FROM fx_lexicon WHERE word NOT IN (SELECT word FROM fx_phon WHERE word LIKE 'a%') UNION ALL SELECT word, CAST(7 AS BIGINT), 'X' FROM fx_phon WHERE word LIKE 'a%'", "fx_lexicon", "fx_phon")
def _(lexicon, phon):
    patch = phon.where("word LIKE 'a%'").select("word", F.lit(7).alias("alt_idx"), F.lit("X").alias("phones"))
    return X.override(lexicon, patch).select("word", _long("alt_idx"), "phones")


@_add("x2_derive_clitics", "SELECT word || 's' AS word, CAST(alt_idx AS BIGINT) AS alt_idx, phones || '_Z' AS phones FROM fx_lexicon WHERE word || 's' NOT IN (SELECT word FROM fx_lexicon)", "fx_lexicon")
def _(lexicon):
    return X.derive_clitics(lexicon, "s", "Z").select("word", _long("alt_idx"), "phones")


@_add("x4_one_diff_words", "SELECT word, 'AH0' AS token, CAST(1 AS BIGINT) AS idx FROM fx_lexicon WHERE alt_idx = 1 AND phones LIKE '%\\_AH0\\_%' ESCAPE '\\'", "fx_lexicon")
def _(lexicon):
    return X.one_diff_words(lexicon).select("word", "token", _long("idx"))


@_add("x8_phone_inventory", "SELECT DISTINCT unnest(string_split(phones, '_')) AS phone FROM fx_lexicon", "fx_lexicon")
def _(lexicon):
    return X.phone_inventory(lexicon)


@_add("x9_alternatives_histogram", "SELECT n_alternatives, count(*) AS n_words FROM (SELECT word, count(*) AS n_alternatives FROM fx_lexicon GROUP BY word) GROUP BY 1", "fx_lexicon")
def _(lexicon):
    return X.alternatives_histogram(lexicon)


@_add("x11_lookup", f"SELECT w.word, coalesce(a.phones, b.phones) AS phones, CASE WHEN a.phones IS NOT NULL THEN 'exact' WHEN b.phones IS NOT NULL THEN 'folded' ELSE 'none' END AS how FROM (SELECT DISTINCT word FROM fx_tokens) w LEFT JOIN (SELECT * FROM fx_lexicon WHERE alt_idx = 0) a ON a.word = w.word LEFT JOIN (SELECT * FROM fx_lexicon WHERE alt_idx = 0) b ON b.word = translate(w.word, '{T.ACCENTED}', '{T.FOLDED}')", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return X.lookup(tokens, lexicon, T.fold_accents)


# joins
@_add("j1_overlap_join", """SELECT w.file_id, w.word_id, string_agg(p.phone, '_' ORDER BY p.start, p.word_id, p.k) AS phones FROM fx_words w JOIN fx_phone_intervals p ON w.file_id = p.file_id AND w.start < p."end" AND p.start < w."end" GROUP BY 1, 2""", "fx_words", "fx_phone_intervals")
def _(words, phones):
    return J.phones_of_words(words, phones)


@_add("j2_label_frames", "SELECT rec_id, frame_idx, f.label, pos AS phone FROM fx_frames f JOIN fx_targets USING (rec_id) WHERE f.frame_idx >= pos * 10 AND f.frame_idx < pos * 10 + 10", "fx_frames", "fx_targets")
def _(frames, targets):
    intervals = targets.select("rec_id", F.col("pos").alias("phone"), (F.col("pos") * 0.25).alias("start"), (F.col("pos") * 0.25 + 0.25).alias("end"))
    return J.label_frames(frames.select("rec_id", "frame_idx", "label"), intervals, 0.025).select("rec_id", "frame_idx", "label", "phone")


@_add("j5_exclude_files", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 990)", "events")
def _(events):
    return J.exclude_files(events, "user_id", F.col("value") > 990).select("event_id", "user_id")


@_add("j6_new_phrases", "SELECT lower(text) AS norm, min(doc_id) AS doc_id FROM documents WHERE lower(text) NOT IN (SELECT lower(text) FROM benchmark) GROUP BY 1", "documents", "benchmark")
def _(docs, items):
    return J.new_phrases(docs, items, F.lower, "doc_id")


@_add("j7_enrich", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)", "documents", "labels")
def _(docs, labels):
    return J.enrich(docs.select("doc_id", "lang"), labels, "doc_id")[0].select("doc_id", "lang", "quality", "toxic")


@_add("j7_enrich_missing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents", "labels")
def _(docs, labels):
    return J.enrich(docs.select("doc_id", "lang"), labels, "doc_id")[1]


@_add("j8_inflection_pairs", "WITH k AS (SELECT DISTINCT word FROM fx_lexicon) SELECT a.word AS base, b.word AS inflected FROM k a JOIN k b ON b.word = a.word || 's'", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return J.inflection_pairs(tokens, lexicon, "s").select("base", "inflected")


@_add("j11_stem_semi", "WITH e AS (SELECT DISTINCT word FROM fx_lexicon) SELECT DISTINCT word FROM fx_tokens WHERE left(word, length(word) - 1) IN (SELECT word FROM e) OR left(word, length(word) - 2) IN (SELECT word FROM e)", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return J.stem_semi(tokens.where("length(word) > 2"), lexicon)


_SQL["j11_stem_semi"] = _SQL["j11_stem_semi"].replace("SELECT DISTINCT word FROM fx_tokens WHERE left", "SELECT DISTINCT word FROM fx_tokens WHERE length(word) > 2 AND (left").replace("IN (SELECT word FROM e) OR", "IN (SELECT word FROM e) OR") + ")"


# metrics
@_add("g1_value_percent", "SELECT target, detection, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY target), 6) AS percent FROM fx_detect GROUP BY 1, 2", "fx_detect")
def _(detect):
    return G.value_percent(detect, "detection", ["target"]).select("target", "detection", "n", _r("percent"))


@_add("g3_confusion_matrix", "SELECT a.x AS target, b.x AS detection, coalesce(n, 0) AS n, CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY a.x) > 0 THEN round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.x), 6) ELSE 0.0 END AS share FROM (SELECT unnest(['A', 'N', 'R', 'Z']) AS x) a CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'Z']) AS x) b LEFT JOIN (SELECT target, detection, count(*) AS n FROM fx_detect GROUP BY 1, 2) c ON c.target = a.x AND c.detection = b.x", "fx_detect")
def _(detect):
    return G.confusion_matrix(detect, ["A", "N", "R", "Z"]).select("target", "detection", "n", _r("share"))


@_add("g5_success_rate", "SELECT target, round(avg(CAST(detection = target AS INT)), 6) AS rate FROM fx_detect GROUP BY 1", "fx_detect")
def _(detect):
    return G.success_rate(detect, ["target"]).select("target", _r("rate"))


@_add("g6_rejection_report", "SELECT status, count(*) AS n, count(*) FILTER (detection = 'A' AND target <> 'A') AS false_accept, count(*) FILTER (detection <> 'A' AND target = 'A') AS false_reject, round(100.0 * count(*) FILTER (detection = 'A' AND target <> 'A') / count(*), 6) AS false_accept_percent, round(100.0 * count(*) FILTER (detection <> 'A' AND target = 'A') / count(*), 6) AS false_reject_percent FROM fx_detect GROUP BY 1", "fx_detect")
def _(detect):
    out = G.rejection_report(detect, ["status"], F.col("detection") == "A", F.col("target") == "A")
    return out.select("status", "n", "false_accept", "false_reject", _r("false_accept_percent"), _r("false_reject_percent"))


@_add("g7_histogram", "SELECT event_type, CAST(least(floor(value / 1000 * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 1000 GROUP BY 1, 2", "events")
def _(events):
    return G.histogram(events, "value", ["event_type"], 0.0, 1000.0, 20)


@_add("g8_frequent_words", "SELECT word, n, round(100.0 * n / (SELECT count(*) FROM fx_tokens), 6) AS percent FROM (SELECT word, count(*) AS n FROM fx_tokens GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)", "fx_tokens")
def _(tokens):
    return G.frequent_words(tokens, 100).select("word", "n", _r("percent"))


@_add("g9_drop_top_words", "SELECT lang, count(*) AS n FROM fx_tokens WHERE word NOT IN (SELECT word FROM (SELECT word, count(*) AS n FROM fx_tokens GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)) GROUP BY 1", "fx_tokens")
def _(tokens):
    return G.drop_top_words(tokens, 50).groupBy("lang").agg(F.count("*").alias("n"))


@_add("g10_error_ranking", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1", "lineitem")
def _(lineitem):
    return lineitem.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey")


@_add("g16_threshold_sweep", "WITH s AS (SELECT l_quantity AS t, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1) SELECT t AS threshold, round(sum(p) OVER (ORDER BY t) / (SELECT sum(p) FROM s), 6) AS tpr, round(sum(q) OVER (ORDER BY t) / (SELECT sum(q) FROM s), 6) AS fpr FROM s", "lineitem")
def _(lineitem):
    return G.threshold_sweep(lineitem, "l_quantity", F.col("l_returnflag") == "R").select("threshold", _r("tpr"), _r("fpr"))


@_add("g18_syllable_set", "SELECT DISTINCT unnest(string_split(phonetics, '|')) AS syllable FROM fx_phon", "fx_phon")
def _(phon):
    return phon.select(F.explode(F.split("phonetics", r"\|")).alias("syllable")).distinct()


@_add("g20_mean_vectors", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, CAST(unnest(range(64)) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2", "embeddings")
def _(embeddings):
    return G.mean_vectors(embeddings, "label", "embedding").select("label", _long("pos"), _r("mean"))


@_add("g21_compare_models", "WITH r AS (SELECT lang AS model, toxic AS target, 100.0 * avg(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT a.model, bool_and(a.rate >= b.rate - 15) AS holds, count(*) AS n_targets FROM r a JOIN r b ON b.target = a.target AND b.model = 'en' WHERE a.model <> 'en' GROUP BY 1", "documents", "labels")
def _(docs, labels):
    rates = docs.join(labels, "doc_id").groupBy(F.col("lang").alias("model"), F.col("toxic").alias("target")).agg((F.lit(100.0) * F.avg("quality")).alias("rate"))
    return G.compare_models(rates, "en", 15.0)


@_add("g24_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1", "events")
def _(events):
    return W.first_per_key(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# windows
_RUNS = "SELECT file_id, word_id, word, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id) AS BIGINT) AS run FROM (SELECT *, CAST(lag(word) OVER (PARTITION BY file_id ORDER BY start, word_id) IS DISTINCT FROM word AS INT) AS new FROM fx_words)"


@_add("w1_run_id", _RUNS, "fx_words")
def _(words):
    return W.run_id(words, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "word", "run")


@_add("w2_dedupe_runs", "SELECT file_id, word_id, word FROM (SELECT *, lag(word) OVER (PARTITION BY file_id ORDER BY start, word_id) AS b FROM fx_words) WHERE b IS DISTINCT FROM word", "fx_words")
def _(words):
    return W.dedupe_runs(words, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "word")


@_add("w2_run_edges", "SELECT file_id, word_id, word FROM (SELECT *, lag(word) OVER w AS b, lead(word) OVER w AS a FROM fx_words WINDOW w AS (PARTITION BY file_id ORDER BY start, word_id)) WHERE b IS DISTINCT FROM word OR a IS DISTINCT FROM word", "fx_words")
def _(words):
    return W.run_edges(words, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "word")


@_add("w4_resolve_overlaps", """SELECT file_id, word_id FROM (SELECT *, min("end") OVER (PARTITION BY file_id ORDER BY start, word_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM fx_words) WHERE "end" = m""", "fx_words")
def _(words):
    return W.resolve_overlaps(words, ["file_id"], ["start", "word_id"]).select("file_id", "word_id")


@_add("w5_sessionize", """SELECT file_id, phrase, string_agg(word, ' ' ORDER BY start, word_id) AS text, min(start) AS start, max("end") AS "end", count(*) AS n_words FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id) AS BIGINT) AS phrase FROM (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY file_id ORDER BY start, word_id) > 3600 THEN 1 ELSE 0 END AS new FROM fx_words)) GROUP BY 1, 2""", "fx_words")
def _(words):
    return W.sessionize(words, 3600.0, ["file_id"], ["start", "word_id"])


@_add("w8_segment_numbers", f"SELECT file_id, word_id, run, row_number() OVER (PARTITION BY file_id, run ORDER BY start, word_id) - 1 AS segment FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY start, word_id) AS BIGINT) AS run FROM (SELECT *, CAST(lag(word) OVER (PARTITION BY file_id ORDER BY start, word_id) IS DISTINCT FROM word AS INT) AS new FROM fx_words))", "fx_words")
def _(words):
    return W.segment_numbers(words, "word", ["file_id"], ["start", "word_id"]).select("file_id", "word_id", "run", _long("segment"))


@_add("w10_top_binary", "SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_orderkey) = 1 OR (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) <= ceil(count(*) OVER (PARTITION BY l_orderkey) / 3.0) AND l_quantity >= 30) AS INT) AS bit FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity FROM lineitem)", "lineitem")
def _(lineitem):
    rows = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return W.top_binary(rows, ["l_orderkey"], "l_quantity", "l_linenumber", 3, 30.0).select("l_orderkey", "l_linenumber", "bit")


@_add("w12_minmax", "SELECT event_id, round(CASE WHEN max(value) OVER (PARTITION BY user_id) > min(value) OVER (PARTITION BY user_id) THEN (value - min(value) OVER (PARTITION BY user_id)) / (max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id)) ELSE 0 END, 6) AS scaled FROM events", "events")
def _(events):
    return W.minmax(events, "value", ["user_id"]).select("event_id", _r("scaled"))


@_add("w15_frequency_band", "WITH c AS (SELECT word, count(*) AS n FROM fx_tokens GROUP BY 1) SELECT word, n, round(percent, 6) AS percent FROM (SELECT word, n, 100.0 * sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c) AS percent FROM c) WHERE percent > 30 AND percent < 90", "fx_tokens")
def _(tokens):
    return W.frequency_band(tokens, 30.0, 90.0).select("word", "n", _r("percent"))


@_add("w16_cap_per_class", "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 20", "embeddings")
def _(embeddings):
    return W.cap_per_class(embeddings, "label", "vec_id", 20).select("vec_id", "label")


@_add("w17_next_word_filter", "SELECT file_id, word_id FROM (SELECT *, lead(word) OVER (PARTITION BY file_id ORDER BY start, word_id) AS a FROM fx_words) WHERE a IS NULL OR NOT starts_with(a, 'p')", "fx_words")
def _(words):
    return W.next_word_filter(words, ["file_id"], ["start", "word_id"], "p").select("file_id", "word_id")


# sets and selections
@_add("o4_tagged_union", "SELECT 'benchmark' AS source, item_id AS id, length(text) AS n FROM benchmark UNION ALL SELECT 'documents', doc_id, length(text) FROM documents", "documents", "benchmark")
def _(docs, items):
    a = items.select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")))


@_add("o5_inventory_diff", "SELECT DISTINCT word FROM fx_tokens EXCEPT SELECT word FROM fx_lexicon", "fx_tokens", "fx_lexicon")
def _(tokens, lexicon):
    return tokens.select("word").subtract(lexicon.select("word"))


@_add("f1_select_words", "SELECT word, phonetics FROM fx_phon WHERE starts_with(phonetics, 'B') AND contains(phonetics, 'IH') AND NOT ends_with(phonetics, 'D')", "fx_phon")
def _(phon):
    c = F.col("phonetics")
    return phon.where(c.startswith("B") & c.contains("IH") & ~c.endswith("D")).select("word", "phonetics")


@_add("f2_has_phone", "SELECT word FROM fx_phon WHERE list_contains(string_split_regex(phonetics, '[ |_]'), 'T')", "fx_phon")
def _(phon):
    return phon.where(F.array_contains(P.phones(F.col("phonetics")), "T")).select("word")


@_add("f3_target_syllable", "SELECT word, list_position(list_transform(string_split(phonetics, '|'), lambda s: list_contains(string_split(s, '_'), 'T')), true) - 1 AS syl FROM fx_phon WHERE list_contains(string_split_regex(phonetics, '[ |_]'), 'T')", "fx_phon")
def _(phon):
    hit = F.transform(F.split("phonetics", r"\|"), lambda s: F.array_contains(F.split(s, "_"), "T"))
    return phon.select("word", (F.array_position(hit, True) - 1).alias("syl")).where("syl >= 0")


# frames
@_add("k4_argmax_phone", "SELECT rec_id, frame_idx, list_position(probs, list_max(probs)) - 1 AS phone, list_max(probs) AS p FROM fx_frames", "fx_frames")
def _(frames):
    return frames.select("rec_id", "frame_idx", K.argmax_phone(F.col("probs")).alias("phone"), F.array_max("probs").alias("p"))


@_add("k8_drop_silence", "SELECT rec_id, frame_idx, row_number() OVER (PARTITION BY rec_id ORDER BY frame_idx) - 1 AS t FROM fx_frames WHERE probs[10] < list_max(probs)", "fx_frames")
def _(frames):
    return K.drop_silence(frames).select("rec_id", "frame_idx", "t")


_ALIGN = """WITH RECURSIVE f AS (SELECT rec_id, frame_idx, probs FROM fx_frames WHERE probs[10] < list_max(probs)),
m AS (SELECT rec_id, list(probs ORDER BY frame_idx) AS m FROM f GROUP BY 1),
g AS (SELECT rec_id, list(phone_id ORDER BY pos) AS goal FROM fx_targets GROUP BY 1),
d AS (
    SELECT rec_id, 1 AS t, m, goal, list_transform(goal, lambda x, j: CASE WHEN j = 1 THEN {'c': -m[1][x + 1], 'p': '0'} ELSE {'c': 1e18::DOUBLE, 'p': ''} END) AS row FROM m JOIN g USING (rec_id) WHERE len(m) >= len(goal)
    UNION ALL
    SELECT rec_id, t + 1, m, goal, list_transform(goal, lambda x, j: CASE WHEN j > 1 AND row[j - 1].c <= row[j].c AND row[j - 1].c < 1e17 THEN {'c': row[j - 1].c - m[t + 1][x + 1], 'p': row[j - 1].p || '|' || (j - 1)} ELSE {'c': row[j].c - m[t + 1][x + 1], 'p': row[j].p || '|' || (j - 1)} END) FROM d WHERE t < len(m)
)
SELECT g.rec_id, round(row[-1].c, 6) AS cost, row[-1].p AS path FROM g LEFT JOIN (SELECT * FROM d WHERE t = len(m)) d USING (rec_id)"""


@_add("k9_force_align", _ALIGN, "fx_frames", "fx_targets")
def _(frames, targets):
    return K.force_align(K.drop_silence(frames), targets).select("rec_id", _r("cost"), _joined(F.col("path")).alias("path"))


@_add("k11_pool", "SELECT label, phone, round(avg(p), 6) AS p FROM (SELECT label, CAST(unnest(range(10)) AS BIGINT) AS phone, unnest(probs) AS p FROM fx_frames) GROUP BY 1, 2", "fx_frames")
def _(frames):
    return K.pool(frames, ["label"]).select("label", _long("phone"), _r("p"))


@_add("w3_posterior_runs", "WITH b AS (SELECT rec_id, frame_idx, list_position(probs, list_max(probs)) - 1 AS phone, list_max(probs) AS p FROM fx_frames), k AS (SELECT *, CAST(lag(phone) OVER (PARTITION BY rec_id ORDER BY frame_idx) IS DISTINCT FROM phone AS INT) AS new FROM b WHERE phone <> 9), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS BIGINT) AS run FROM k), o AS (SELECT rec_id, run, phone, count(*) AS n, max(p) AS m, sum(p) AS s, min(frame_idx) AS f FROM r GROUP BY 1, 2, 3 HAVING max(p) > 0.3), q AS (SELECT *, CAST(lag(phone) OVER (PARTITION BY rec_id ORDER BY f) IS DISTINCT FROM phone AS INT) AS new FROM o), t AS (SELECT *, CAST(sum(new) OVER (PARTITION BY rec_id ORDER BY f) AS BIGINT) AS again FROM q) SELECT rec_id, again AS run, CAST(phone AS BIGINT) AS phone, CAST(sum(n) AS BIGINT) AS n_frames, max(m) AS p_max, round(sum(s) / sum(n), 6) AS p_mean, CAST(min(f) AS BIGINT) AS first_frame FROM t GROUP BY 1, 2, 3", "fx_frames")
def _(frames):
    return K.posterior_runs(frames, 0.3, 9).select("rec_id", "run", "phone", "n_frames", "p_max", _r("p_mean"), "first_frame")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
