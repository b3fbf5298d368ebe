"""Queries from text to pronunciation: numbers, marks, syllables, dictionaries, sentences, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.functions import numbers as N
from speechlab.functions import phonetics as P
from speechlab.functions import text as T
from speechlab.operators import lexicon as X
from speechlab.operators import phonetize as Z
from speechlab.operators import syllables as Y
from speechlab.plans.registry import add
from speechlab.plans.scratch import kept

_WS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


def _joined(arr, sep: str = "|"):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)


def _long(col: str):
    return F.col(col).cast("long").alias(col)


def _words(text="text"):
    return F.filter(F.split(text, " "), lambda w: w != "")


# numbers
_UNIT = "CASE WHEN {0} = 1 THEN '{1}' ELSE '{1}s' END"
_PRICE = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(15, 2)) AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem"


@add("t5_expand_symbols", f"WITH a AS (SELECT *, CAST(floor(p) AS BIGINT) AS d, CAST((p - floor(p)) * 100 AS BIGINT) AS c FROM ({_PRICE})) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c > 0 THEN d || ' ' || {_UNIT.format('d', 'dollar')} || ' and ' || c || ' ' || {_UNIT.format('c', 'cent')} ELSE d || ' ' || {_UNIT.format('d', 'dollar')} END || ' at ' || q || ' percent, 1 euro, ' || d || ' point ' || q || ' of 7500' AS out FROM a", "lineitem")
def _(lineitem):
    rows = lineitem.select("l_orderkey", _long("l_linenumber"), "l_partkey", F.col("l_extendedprice").cast("decimal(15,2)").alias("p"), F.col("l_quantity").cast("long").cast("string").alias("q"))
    text = F.concat(F.lit("$"), F.col("p").cast("string"), F.lit(" at %"), "q", F.lit(", 1.00€, "), F.floor("p").cast("string"), F.lit("."), "q", F.lit(" of 7,500"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", N.expand_symbols(text).alias("out"))


_ONES, _TENS = (str(x) for x in (N.ONES, N.TENS))


def _below(x: str) -> str:
    small = f"CASE WHEN {x} % 100 < 20 THEN {_ONES}[{x} % 100 + 1] WHEN {x} % 10 = 0 THEN {_TENS}[{x} % 100 // 10 + 1] ELSE {_TENS}[{x} % 100 // 10 + 1] || '-' || {_ONES}[{x} % 10 + 1] END"
    return f"concat_ws(' ', CASE WHEN {x} >= 100 THEN {_ONES}[{x} // 100 + 1] || ' hundred' END, CASE WHEN {x} % 100 > 0 THEN {small} END)"


# groups of three digits apart by commas; a last group below 100 follows another one without a comma
_HIGHER = ", ".join(f"CASE WHEN n // {1000**k} % 1000 > 0 THEN {_below(f'(n // {1000**k} % 1000)')} || '{N.GROUPS[k]}' END" for k in (3, 2, 1))
_CARDINAL = f"concat_ws(CASE WHEN n % 1000 < 100 THEN ' ' ELSE ', ' END, CASE WHEN n >= 1000 THEN concat_ws(', ', {_HIGHER}) END, CASE WHEN n % 1000 > 0 THEN {_below('(n % 1000)')} END)"
_YEAR = f"CASE WHEN n = 2000 THEN 'two thousand' WHEN n > 2000 AND n < 2010 THEN 'two thousand ' || {_below('(n % 100)')} WHEN n % 100 = 0 THEN {_below('(n // 100)')} || ' hundred' WHEN n % 100 < 10 THEN {_below('(n // 100)')} || ' oh ' || {_below('(n % 100)')} ELSE {_below('(n // 100)')} || ' ' || {_below('(n % 100)')} END"


@add("t6_number_words", f"SELECT CAST(n AS VARCHAR) AS token, CASE WHEN n > 1000 AND n < 3000 THEN {_YEAR} ELSE {_CARDINAL} END AS words FROM (SELECT DISTINCT unnest([l_orderkey % 1000000, l_orderkey % 3000, l_partkey]) AS n FROM lineitem) WHERE n > 0", "lineitem")
def _(lineitem):
    keys = F.array(F.col("l_orderkey") % 1000000, F.col("l_orderkey") % 3000, F.col("l_partkey").cast("long"))
    return N.number_table(lineitem.select(F.explode(keys).alias("n")).where("n > 0").select(F.col("n").cast("string").alias("token")))


# marks and words of turns
_MARKS = T.MARKS.replace("'", "''")
_SET = "[" + "".join("\\" + c if c.isascii() else c for c in T.MARKS) + "]"
_BARE = f"list_transform({_WS}, lambda w: translate(replace(w, '’', ''''), '{_MARKS}', ''))"


@add("t7_brace_groups", f"SELECT conv_id, turn, array_to_string(list_transform({_WS}, lambda w: CASE WHEN length(w) > 6 THEN '{{' || w || ' x}}' ELSE w END), ' ') AS norm, array_to_string(list_transform({_WS}, lambda w: CASE WHEN length(w) > 6 THEN '{{' || w || '}}' ELSE w END), ' ') AS source FROM conversations", "conversations")
def _(turns):
    longer = F.transform(_words(), lambda w: F.when(F.length(w) > 6, F.concat(w, F.lit(" x"))).otherwise(w))
    both = turns.select("conv_id", "turn", T.brace_groups(_words(), longer).alias("b"))
    return both.select("conv_id", "turn", F.array_join("b.norm", " ").alias("norm"), F.array_join("b.source", " ").alias("source"))


@add("t9_reattach", f"SELECT conv_id, turn, array_to_string(list_transform({_WS}, lambda w: regexp_extract(w, '^{_SET}+') || upper(translate(replace(replace(w, 'ß', 's'), '’', ''''), '{_MARKS}', '')) || regexp_extract(w, '{_SET}+$')), ' ') AS out FROM conversations", "conversations")
def _(turns):
    maps = T.edge_maps(_words())
    rows = turns.select("conv_id", "turn", F.transform(T.strip_marks(_words()), lambda w: F.upper(F.replace(w, F.lit("ß"), F.lit("s")))).alias("w"), maps.alias("m"))
    return rows.select("conv_id", "turn", F.array_join(T.reattach(F.col("w"), F.col("m.before"), F.col("m.after")), " ").alias("out"))


_UP = "upper(w) = w AND lower(w) <> w"
_SHOUT = f"(SELECT conv_id, turn, list_transform({_BARE}, lambda w, i: CASE WHEN i % 3 = 0 THEN upper(replace(w, 'ß', 's')) ELSE w END) AS ws FROM conversations)"


def _shouted(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.transform(T.strip_marks(_words()), lambda w, i: F.when((i + 1) % 3 == 0, F.upper(F.replace(w, F.lit("ß"), F.lit("s")))).otherwise(w)).alias("ws"))


@add("t11_acronym_indexes", f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(ws, lambda w, i: CASE WHEN {_UP} THEN i - 1 END), lambda i: i IS NOT NULL), ',') AS idxs, array_to_string(list_transform(ws, lambda w: lower(CASE WHEN {_UP} THEN array_to_string(list_filter(string_split(w, ''), lambda c: c <> ''), '-') ELSE w END)), ' ') AS spelled FROM {_SHOUT}", "conversations")
def _(turns):
    rows = _shouted(turns)
    return rows.select("conv_id", "turn", _joined(T.acronym_indexes(F.col("ws")), ",").alias("idxs"), F.array_join(T.spell_acronyms(F.col("ws")), " ").alias("spelled"))


@add("t12_acronym_compound", f"SELECT conv_id, turn, array_to_string(list_transform(ws, lambda w: CASE WHEN {_UP} AND length(w) > 1 THEN '{{' || replace(w, '-', ' ') || '}}' ELSE w END), ' ') AS out FROM {_SHOUT}", "conversations")
def _(turns):
    rows = _shouted(turns)
    return rows.select("conv_id", "turn", F.array_join(T.acronym_compound(F.col("ws"), T.acronym_indexes(F.col("ws")), True), " ").alias("out"))


@add("t14_restore_case", "SELECT word, string_agg(upper(syl), '|' ORDER BY syl_idx) AS out FROM fx_syl GROUP BY 1", "fx_syl")
def _(syl):
    rows = syl.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("syl_idx", "syl"))), lambda x: x["syl"]).alias("s"))
    return rows.select("word", F.array_join(T.restore_case(F.array(F.array_join("s", "|")), F.array(F.upper("word"))), " ").alias("out"))


@add("t16_rewrite_lines", "SELECT event_id, 'E-C' || user_id || '.wav,P' || user_id % 3 || '-0' || event_id % 9 + 1 || ' s' AS x FROM events", "events")
def _(events):
    line = F.concat(F.lit("E-C"), F.col("user_id").cast("string"), F.lit("-P"), (F.col("user_id") % 3).cast("string"), F.lit(",000"), (F.col("event_id") % 9 + 1).cast("string"), F.lit(" s"))
    return events.select("event_id", T.rewrite_utterance_line(line).alias("x"))


@add("t19_first_focus", f"SELECT conv_id, turn, nullif(list_position(list_transform({_WS}, lambda w, i: length(w) > 5 AND i % 2 = 0), true) - 1, -1) AS first FROM conversations", "conversations")
def _(turns):
    marked = F.array_join(F.transform(_words(), lambda w, i: F.when((F.length(w) > 5) & ((i + 1) % 2 == 0), F.concat(w, F.lit("*"))).otherwise(F.replace(w, F.lit("*"), F.lit("")))), " ")
    return turns.select("conv_id", "turn", T.first_focus(marked).cast("long").alias("first"))


# phones
_SYLS = "string_split(phonetics, '|')"
_PLAIN = "regexp_replace(phonetics, '[012]', '', 'g')"


@add("p9_target_error", f"WITH a AS (SELECT word, length(word) % 4 AS s, {_SYLS} AS x FROM fx_phon) SELECT word, CASE WHEN length(word) % 5 = 0 THEN 'target phone QQ is not a phoneme' WHEN s >= len(x) THEN 'syl_idx >= n of syllables' WHEN NOT contains(x[CAST(s + 1 AS INT)], 'T') THEN 'target not in syllable' WHEN len(list_filter(string_split(x[CAST(s + 1 AS INT)], '_'), lambda p: p = 'T')) <= 0 THEN 'target_occurence_idx >= n of ocurrences in syllable' END AS error FROM a", "fx_phon")
def _(phon):
    target = F.when(F.length("word") % 5 == 0, "QQ").otherwise("T")
    alphabet = [*{p for ps in P.CATEGORIES.values() for p in ps}, "AE", "EH", "IH", "OW", "UH"]
    return phon.select("word", P.target_error(F.col("phonetics"), target, F.lit(0), F.length("word") % 4, alphabet, F.lit(0)).alias("error"))


@add("p14_rle", "WITH a AS (SELECT word, i, CAST(regexp_matches(p, '[012]$') AS INT) AS v FROM (SELECT word, unnest(range(len(x))) AS i, unnest(x) AS p FROM (SELECT word, string_split_regex(phonetics, '[|_]') AS x FROM fx_phon))), b AS (SELECT *, CAST(lag(v) OVER (PARTITION BY word ORDER BY i) IS DISTINCT FROM v AS INT) AS new FROM a), c AS (SELECT *, sum(new) OVER (PARTITION BY word ORDER BY i) AS run FROM b), d AS (SELECT word, run, min(v) AS v, count(*) AS n FROM c GROUP BY 1, 2) SELECT word, string_agg(v || 'x' || n, ' ' ORDER BY run) AS runs FROM d GROUP BY 1", "fx_phon")
def _(phon):
    runs = P.rle(F.transform(P.phones(F.col("phonetics")), lambda p: p.rlike("[012]$").cast("int")))
    return phon.select("word", F.array_join(F.transform(runs, lambda r: F.concat(r["value"].cast("string"), F.lit("x"), r["n"].cast("string"))), " ").alias("runs"))


_VOWELS = ["AE", "EH", "IH", "OW", "UH"]


@add("p16_add_stress", f"WITH a AS (SELECT word, string_split({_PLAIN}, '|') AS x, length(word) % 3 AS s FROM fx_phon) SELECT word, array_to_string(CASE WHEN len(x) = length(word) // 2 THEN list_transform(x, lambda y, i: regexp_replace(y, '(AE|EH|IH|OW|UH)', '\\1' || CASE WHEN i - 1 = s THEN '1' ELSE '0' END)) ELSE x END, '|') AS out FROM a", "fx_phon")
def _(phon):
    plain = F.transform(F.split(F.regexp_replace("phonetics", "[012]", ""), r"\|"), lambda s: F.split(s, "_"))
    out = P.add_stress(plain, F.length("word") % 3, F.floor(F.length("word") / 2).cast("int"), _VOWELS)
    return phon.select("word", P.format_phonetics(out).alias("out"))


@add("p17_stressed_syllable", f"SELECT word, CASE WHEN length(word) % 4 > 0 THEN list_position(list_transform({_SYLS}, lambda s: contains(s, '1')), true) - 1 END AS idx, len({_SYLS}) AS n FROM fx_phon", "fx_phon")
def _(phon):
    marked = F.transform(F.element_at(P.split_phonetics(F.col("phonetics")), 1), lambda s: F.transform(s, lambda p: F.when(p.endswith("1") & (F.length("word") % 4 > 0), F.concat(F.lit("ˈ"), p)).otherwise(p)))
    return phon.select("word", P.stressed_syllable(marked).cast("long").alias("idx"), F.size(marked).cast("long").alias("n"))


@add("p18_one_insertion", "SELECT word, CAST(1 AS BIGINT) AS idx FROM fx_lexicon WHERE alt_idx = 1 AND phones LIKE '%\\_AH0\\_%' ESCAPE '\\'", "fx_lexicon")
def _(lexicon):
    both = lexicon.groupBy("word").agg(F.min_by("phones", "alt_idx").alias("a"), F.max_by("phones", "alt_idx").alias("b"))
    return both.select("word", P.one_insertion(F.split("a", "_"), F.split("b", "_")).cast("long").alias("idx")).where("idx is not null")


@add("p20_substitute_basis", f"WITH a AS (SELECT word, {_SYLS} AS x FROM fx_phon), b AS (SELECT word, x, string_split(x[-1], '_') AS y FROM a) SELECT word, array_to_string(list_concat(list_concat(string_split(array_to_string(x[:-2], '_'), '_'), y[:-2]), ['IH0', 'D']), '_') AS phones, array_to_string(list_transform(y[-2:], lambda p: regexp_replace(p, '[012]$', '')), '_') AS truth FROM b WHERE len(x) > 1", "fx_phon")
def _(phon):
    syls = F.element_at(P.split_phonetics(F.col("phonetics")), 1)
    rows = phon.select("word", syls.alias("s")).where(F.size("s") > 1)
    out = rows.select("word", P.substitute_basis(F.col("s"), F.size("s") - 1, F.lit(1), F.array(F.lit("IH0"), F.lit("D")), "end").alias("o"))
    return out.select("word", F.array_join("o.phones", "_").alias("phones"), F.array_join("o.truth", "_").alias("truth"))


_CATS = {k: "".join(v) for k, v in P.LETTERS.items()}


@add("p22_letter_categories", "WITH l AS (SELECT unnest(string_split(word, '')) AS c FROM fx_tokens) SELECT CASE " + " ".join(f"WHEN contains('{v}', c) THEN '{k}'" for k, v in _CATS.items()) + " END AS category, count(*) AS n FROM l WHERE c <> '' GROUP BY 1", "fx_tokens")
def _(tokens):
    letters = tokens.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''")
    return letters.groupBy(P.category(F.col("c"), "letters").alias("category")).agg(F.count("*").alias("n"))


@add("p24_glide_schwa", "WITH g AS (SELECT word, replace(replace(phonetics, 'IH', 'ɪ'), '|EH0', '|ə0') AS p FROM fx_phon), m AS (SELECT word, p, regexp_replace(regexp_replace(p, '(ɪ)([012]?)\\|ə', '\\1\\2_ə', 'g'), '(ɪ)([012])_ə[012]', '\\1\\2_ə', 'g') AS q FROM g) SELECT word, CAST(k AS BIGINT) AS k, form FROM (SELECT word, unnest(CASE WHEN p = q THEN [0] ELSE [0, 1] END) AS k, unnest(CASE WHEN p = q THEN [p] ELSE [q, p] END) AS form FROM m)", "fx_phon")
def _(phon):
    given = F.replace(F.replace("phonetics", F.lit("IH"), F.lit("ɪ")), F.lit("|EH0"), F.lit("|ə0"))
    return phon.select("word", F.posexplode(P.glide_schwa_alternatives(given)).alias("k", "form")).select("word", _long("k"), "form")


@add("p25_ids_and_back", "WITH p AS (SELECT DISTINCT unnest(string_split(phones, '_')) AS phone FROM fx_lexicon) SELECT phone, row_number() OVER (ORDER BY phone) - 1 AS id, phone AS back FROM p UNION ALL SELECT '[SIL]', (SELECT count(*) FROM p), '[SIL]'", "fx_lexicon")
def _(lexicon):
    ids = P.alphabet_ids(X.phone_inventory(lexicon).unionByName(lexicon.sparkSession.createDataFrame([("[SIL]",)], "phone string")))
    return ids.join(ids.select("id", F.col("phone").alias("back")), "id").select("phone", "id", "back")


# syllables
_TEXT = "SELECT word, string_agg(syl, '|' ORDER BY syl_idx) AS s, count(*) AS n FROM fx_syl GROUP BY 1"


def _hyphenated(syl: DataFrame, sep: str = "|") -> DataFrame:
    return syl.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syl_idx", "syl"))), lambda x: x["syl"]), sep).alias("syllables"), F.count("*").alias("n"))


def _dictionary(syl: DataFrame, lexicon: DataFrame) -> DataFrame:
    every = kept(_hyphenated(syl))
    return Y.build_syllable_dict(every.where(F.length("word") % 2 == 0), every.where(F.length("word") % 2 == 1), lexicon)


@add("y2_syllable_dict", f"WITH t AS ({_TEXT}) SELECT s AS syllables, t.word, n AS n_syls, len(regexp_extract_all(phones, '[012]')) AS n_syls_phones FROM t LEFT JOIN (SELECT * FROM fx_lexicon WHERE alt_idx = 0) l ON l.word = t.word", "fx_syl", "fx_lexicon")
def _(syl, lexicon):
    return _dictionary(syl, lexicon)


_FR = "regexp_replace(replace(s, '|', '-'), '^(s|ch)-', '\\1')"


@add("y3_syllable_dict_fr", f"WITH t AS ({_TEXT}), a AS (SELECT word, {_FR} AS p, n - length(word) % 2 AS n FROM t), b AS (SELECT *, len(string_split(p, '-')) - n AS extra FROM a) SELECT replace(p, '-', '|') AS syllables, word, n AS n_syls, CAST(NULL AS BIGINT) AS n_syls_phones FROM b WHERE extra = 0 UNION ALL SELECT replace(regexp_replace(p, '-([^-]*)$', '\\1'), '-', '|'), word, n, NULL FROM b, (VALUES ('e'), ('es'), ('ent'), ('-s'), ('e-ment')) AS v(e) WHERE extra = 1 AND ends_with(p, e)", "fx_syl")
def _(syl):
    raw = _hyphenated(syl, "-").select("word", F.col("syllables").alias("parts"), (F.col("n") - F.length("word") % 2).alias("n_syls"))
    return Y.build_syllable_dict_fr(raw)


@add("y4_syllabified_text", f"WITH t AS ({_TEXT}), v AS (SELECT DISTINCT word, len(regexp_extract_all(word, '[aeiou]')) AS n FROM fx_tokens) SELECT v.word, CASE WHEN v.n = 1 THEN '1 vowel = 1 syl' WHEN t.word IS NOT NULL THEN 'dataset' ELSE 'sonority' END AS method, CASE WHEN v.n = 1 THEN v.word ELSE s END AS syllables FROM v LEFT JOIN t ON t.word = v.word", "fx_tokens", "fx_syl", "fx_lexicon")
def _(tokens, syl, lexicon):
    words = tokens.select("word", F.regexp_count("word", F.lit("[aeiou]")).alias("n_vowels"))
    out = Y.syllabified_text(words, _dictionary(syl, lexicon), "en")
    return out.select("word", "method", F.when(F.col("method") != "sonority", F.col("syllables")).alias("syllables"))


@add("y5_ending_rules", None, "fx_tokens")
def _(tokens):
    return Y.ending_rules(tokens.where("lang = 'en'"), "en")


@add("y6_transfer_syllables", None, "fx_lexicon")
def _(lexicon):
    return Y.transfer_syllables(lexicon, "CMU").select("word", "phones", F.array_join("syllables", "|").alias("syllables"))


@add("y7_format_lexicon", "SELECT word, phonetics FROM fx_phon", "fx_lexicon")
def _(lexicon):
    return Y.format_lexicon(lexicon)


# lexicons and sentences
@add("x5_schwa_alternative", "WITH l AS (SELECT word, regexp_replace(phones, '[012]', '', 'g') AS phones FROM fx_lexicon WHERE alt_idx = 0) SELECT word, CAST(0 AS BIGINT) AS alt_idx, phones FROM l UNION ALL SELECT word, 1, regexp_replace(l.phones, '^([A-Z]+)_', '\\1_ə_') FROM l WHERE word IN (SELECT word FROM fx_lexicon WHERE alt_idx = 1 AND phones LIKE '%\\_AH0\\_%' ESCAPE '\\')", "fx_lexicon")
def _(lexicon):
    bare = lexicon.where("alt_idx = 0").select("word", "alt_idx", F.regexp_replace("phones", "[012]", "").alias("phones"))
    return Z.add_schwa_alternative(bare, lexicon, {"AX": "AH"}).select("word", _long("alt_idx"), "phones")


@add("x7_repair_from", "SELECT word, CAST(alt_idx AS BIGINT) AS alt_idx, CASE WHEN starts_with(p, 'F_') AND starts_with(x, 'F_') THEN 'TH' || p[2:] ELSE p END AS phones FROM (SELECT l.word, l.alt_idx, a.phones AS x, CASE WHEN ends_with(a.phones, '_N') AND NOT regexp_matches(a.phones, '[AEO][EHW][012]_N$') AND length(l.word) % 2 = 0 THEN regexp_replace(l.phones, '_N$', '_n̩') ELSE l.phones END AS p FROM fx_lexicon l JOIN (SELECT word, phones FROM fx_lexicon WHERE alt_idx = 0) a ON a.word = l.word)", "fx_lexicon")
def _(lexicon):
    tail = F.when(F.length("word") % 2 == 0, F.regexp_replace("phones", "_N$", "_n̩")).otherwise(F.col("phones"))
    other = lexicon.select("word", "alt_idx", F.regexp_replace(tail, "^F_", "TH_").alias("phones"))
    vowels = [f"{v}{d}" for v in ("AE", "EH", "OW") for d in "012"]
    return Z.repair_from(lexicon, other, vowels, {"N": "n̩"}, (("F", "TH"),)).select("word", _long("alt_idx"), "phones")


def _sentences(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pairs of neighbouring words that the lexicon has, capitalised and with a mark (a single capital would be an acronym)."""
    known = tokens.where(F.length("word") > 1).join(lexicon.select("word").distinct(), "word", "left_semi").withColumn("sent_id", F.expr("doc_id * 1000000 + pos div 2"))
    rows = known.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("r")).where(F.size("r") == 2)
    return rows.select("sent_id", F.concat(F.initcap(F.array_join(F.transform("r", lambda x: x["word"]), " ")), F.lit(" , ok.")).alias("text"))


_PAIRS = "p AS (SELECT doc_id * 1000000 + pos // 2 AS sent_id, pos, t.word FROM fx_tokens t WHERE length(t.word) > 1 AND t.word IN (SELECT word FROM fx_lexicon)), two AS (SELECT sent_id FROM p GROUP BY 1 HAVING count(*) = 2), w AS (SELECT p.sent_id, p.pos, p.word, f.phonetics, s.s, s.n, a.n_alt FROM p JOIN two USING (sent_id) JOIN fx_phon f ON f.word = p.word JOIN t s ON s.word = p.word JOIN (SELECT word, count(*) AS n_alt FROM fx_lexicon GROUP BY 1) a ON a.word = p.word)"


@add("x17_phonetize", f"WITH t AS ({_TEXT}), {_PAIRS} SELECT sent_id, string_agg(upper(word[1]) || word[2:], ' ' ORDER BY pos) || ', ok.' AS text, string_agg(phonetics, ' ' ORDER BY pos) || ' OW1_K' AS phonetics, string_agg(upper(s[1]) || s[2:], ' ' ORDER BY pos) || ' ok' AS segmented_text, string_agg(CASE WHEN n = 1 THEN '1 vowel = 1 syl' ELSE 'dataset' END, '|' ORDER BY pos) || '|1 vowel = 1 syl' AS methods, string_agg(n_alt, ',' ORDER BY pos) || ',1' AS n_alternatives, '' AS n_syl_mismatches, '' AS n_stress_inconsistencies FROM w GROUP BY 1", "fx_tokens", "fx_lexicon", "fx_syl")
def _(tokens, lexicon, syl):
    more = lexicon.where("word <> 'ok'").unionByName(lexicon.sparkSession.createDataFrame([("ok", 0, "OW1_K")], "word string, alt_idx int, phones string"))
    more = kept(more)
    out = Z.phonetize(kept(_sentences(tokens, lexicon)), more, kept(_dictionary(syl, more)))
    joined = [_joined(F.col(c), s).alias(c) for c, s in (("methods", "|"), ("n_alternatives", ","), ("n_syl_mismatches", ","), ("n_stress_inconsistencies", ","))]
    return out.select("sent_id", "text", "phonetics", "segmented_text", *joined)


@add("x17_phonetize_errors", "WITH k AS (SELECT DISTINCT word FROM fx_lexicon), d AS (SELECT doc_id, pos, t.word, k.word IS NULL AS lacks FROM fx_tokens t LEFT JOIN k ON k.word = translate(t.word, 'àáâäãåçèéêëìíîïñòóôöõùúûüÿ', 'aaaaaaceeeeiiiinooooouuuuy') WHERE length(t.word) > 1) SELECT CAST(doc_id * 1000000 + pos // 3 AS BIGINT) AS sent_id, arg_min(word, pos) AS word FROM d WHERE lacks GROUP BY 1", "fx_tokens", "fx_lexicon", "fx_syl")
def _(tokens, lexicon, syl):
    rows = tokens.where(F.length("word") > 1).withColumn("sent_id", F.expr("doc_id * 1000000 + pos div 3"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    lexicon = kept(lexicon)
    return Z.phonetize_safe(kept(rows.groupBy("sent_id").agg(text.alias("text"))), lexicon, kept(_dictionary(syl, lexicon)))[1]


_OPEN = _PAIRS.replace("AND t.word IN (SELECT word FROM fx_lexicon)", "AND t.word IN (SELECT word FROM fx_phon WHERE regexp_matches(phonetics, '[012]$'))")


@add("x19_mismatch_report", f"WITH t AS ({_TEXT}), {_OPEN} SELECT sent_id, CAST(3 AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS place, upper(arg_min(s, pos)[1]) || arg_min(s, pos)[2:] AS word, replace(arg_min(phonetics, pos), '1', '0') || '|AH1' AS phonetics FROM w GROUP BY 1", "fx_tokens", "fx_lexicon", "fx_syl")
def _(tokens, lexicon, syl):
    longer = lexicon.where("alt_idx = 0 and word <> 'ok' and phones rlike '[012]$'").withColumn("phones", F.concat(F.replace("phones", F.lit("1"), F.lit("0")), F.lit("_AH1")))
    more = kept(longer.unionByName(lexicon.sparkSession.createDataFrame([("ok", 0, "OW1_K")], "word string, alt_idx int, phones string")))
    return Z.mismatch_report(Z.phonetize(kept(_sentences(tokens, longer)), more, kept(_dictionary(syl, more))))
