"""Derived tables that stand for lexicons, frames and intervals, in Spark SQL and in DuckDB SQL.

Each is built from the base tables, so its work grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from speechlab.plans.scratch import kept

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SPARK: dict[str, str] = {
    "fx_tokens": "SELECT d.doc_id, d.lang, t.pos, t.word FROM documents d LATERAL VIEW posexplode(filter(split(lower(regexp_replace(d.text, r'[^\\p{L} ]', ' ')), ' +'), w -> w <> '')) t AS pos, word",
    "fx_neighbours": "SELECT doc_id, lang, t.pos, x.word, x.next FROM (SELECT doc_id, lang, ws, slice(ws, 2, greatest(size(ws) - 1, 0)) AS later FROM (SELECT d.doc_id, d.lang, filter(split(lower(regexp_replace(d.text, r'[^\\p{L} ]', ' ')), ' +'), w -> w <> '') AS ws FROM documents d)) LATERAL VIEW posexplode(transform(arrays_zip(ws, later), z -> named_struct('word', z.ws, 'next', z.later))) t AS pos, x",
    "fx_letter_phone": "SELECT * FROM VALUES ('a','AE'), ('b','B'), ('c','K'), ('d','D'), ('e','EH'), ('f','F'), ('g','G'), ('h','HH'), ('i','IH'), ('j','JH'), ('k','K'), ('l','L'), ('m','M'), ('n','N'), ('o','OW'), ('p','P'), ('q','K'), ('r','R'), ('s','S'), ('t','T'), ('u','UH'), ('v','V'), ('w','W'), ('x','Z'), ('y','Y'), ('z','Z') AS t(letter, phone)",
    "fx_syl": "SELECT w.word, t.syl_idx, t.syl FROM (SELECT DISTINCT word FROM fx_tokens WHERE word RLIKE '^([b-df-hj-np-tv-z]?[aeiou])+[b-df-hj-np-tv-z]?$') w LATERAL VIEW posexplode(regexp_extract_all(w.word, '[b-df-hj-np-tv-z]?[aeiou](?:[b-df-hj-np-tv-z]$)?', 0)) t AS syl_idx, syl",
    "fx_phones_of_word": "SELECT x.word, x.syl_idx, x.pos, p.phone || CASE WHEN x.letter IN ('a','e','i','o','u') THEN IF(x.syl_idx = 0, '1', '0') ELSE '' END AS phone FROM (SELECT s.word, s.syl_idx, q.pos, substring(s.syl, q.pos + 1, 1) AS letter FROM fx_syl s LATERAL VIEW explode(sequence(0, length(s.syl) - 1)) q AS pos) x JOIN fx_letter_phone p ON p.letter = x.letter",
    "fx_phon": "SELECT word, array_join(transform(array_sort(collect_list(named_struct('i', syl_idx, 's', s))), x -> x.s), '|') AS phonetics FROM (SELECT word, syl_idx, array_join(transform(array_sort(collect_list(named_struct('i', pos, 'p', phone))), x -> x.p), '_') AS s FROM fx_phones_of_word GROUP BY word, syl_idx) GROUP BY word",
    "fx_lexicon": "SELECT word, x.alt_idx, x.phones FROM (SELECT word, replace(phonetics, '|', '_') AS p FROM fx_phon) LATERAL VIEW inline(IF(length(word) > 4, array(named_struct('alt_idx', 0, 'phones', p), named_struct('alt_idx', 1, 'phones', regexp_replace(p, '^([A-Z]+[0-2]?)_', '$1_AH0_'))), array(named_struct('alt_idx', 0, 'phones', p)))) x AS alt_idx, phones",
    "fx_frames": 'SELECT rec_id, frame_idx, label, transform(e, x -> round(x / aggregate(e, 0D, (a, y) -> a + y), 6)) AS probs FROM (SELECT vec_id div 50 AS rec_id, vec_id % 50 AS frame_idx, label, transform(slice(embedding, 1, 10), x -> exp(8D * CAST(x AS DOUBLE))) AS e FROM embeddings)',
    "fx_targets": 'SELECT rec_id, frame_idx div 10 AS pos, label % 9 AS phone_id FROM fx_frames WHERE frame_idx % 10 = 0',
    "fx_words": 'SELECT user_id AS file_id, event_id AS word_id, event_type AS word, (unix_micros(ts) - 1704067200000000) / 1000000D AS start, (unix_micros(ts) - 1704067200000000) / 1000000D + 30D AS end FROM (SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events)',
    "fx_phone_intervals": 'SELECT w.file_id, w.word_id, k.k, substring(w.word, k.k + 1, 1) AS phone, w.start + 10D * k.k AS start, w.start + 10D * (k.k + 1) AS end FROM fx_words w LATERAL VIEW explode(array(0, 1, 2)) k AS k',
    "fx_detect": "SELECT l_orderkey * 10 + l_linenumber AS rec, l_returnflag AS target, CASE l_linenumber % 4 WHEN 0 THEN 'N' WHEN 1 THEN l_returnflag ELSE substring('ANR', CAST(l_quantity AS INT) % 3 + 1, 1) END AS detection, l_linestatus AS status FROM lineitem",
}

DUCK: dict[str, str] = {
    "fx_tokens": "WITH a AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(regexp_replace(text, '[^\\p{L} ]', ' ', 'g')), ' +'), lambda w: w <> '') AS ws FROM documents) SELECT doc_id, lang, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM a",
    "fx_neighbours": "SELECT doc_id, lang, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM fx_tokens",
    "fx_letter_phone": "SELECT * FROM (VALUES ('a','AE'), ('b','B'), ('c','K'), ('d','D'), ('e','EH'), ('f','F'), ('g','G'), ('h','HH'), ('i','IH'), ('j','JH'), ('k','K'), ('l','L'), ('m','M'), ('n','N'), ('o','OW'), ('p','P'), ('q','K'), ('r','R'), ('s','S'), ('t','T'), ('u','UH'), ('v','V'), ('w','W'), ('x','Z'), ('y','Y'), ('z','Z')) AS t(letter, phone)",
    "fx_syl": "WITH w AS (SELECT DISTINCT word FROM fx_tokens WHERE regexp_full_match(word, '([b-df-hj-np-tv-z]?[aeiou])+[b-df-hj-np-tv-z]?')), a AS (SELECT word, regexp_extract_all(word, '[b-df-hj-np-tv-z]?[aeiou](?:[b-df-hj-np-tv-z]$)?', 0) AS s FROM w) SELECT word, unnest(range(len(s))) AS syl_idx, unnest(s) AS syl FROM a",
    "fx_phones_of_word": "SELECT x.word, x.syl_idx, x.pos, p.phone || CASE WHEN x.letter IN ('a','e','i','o','u') THEN CASE WHEN x.syl_idx = 0 THEN '1' ELSE '0' END ELSE '' END AS phone FROM (SELECT word, syl_idx, pos, substring(syl, CAST(pos + 1 AS INT), 1) AS letter FROM (SELECT word, syl_idx, syl, unnest(range(length(syl))) AS pos FROM fx_syl)) x JOIN fx_letter_phone p ON p.letter = x.letter",
    "fx_phon": "SELECT word, string_agg(s, '|' ORDER BY syl_idx) AS phonetics FROM (SELECT word, syl_idx, string_agg(phone, '_' ORDER BY pos) AS s FROM fx_phones_of_word GROUP BY word, syl_idx) GROUP BY word",
    "fx_lexicon": "SELECT word, 0 AS alt_idx, replace(phonetics, '|', '_') AS phones FROM fx_phon UNION ALL SELECT word, 1, regexp_replace(replace(phonetics, '|', '_'), '^([A-Z]+[0-2]?)_', '\\1_AH0_') FROM fx_phon WHERE length(word) > 4",
    "fx_frames": 'SELECT rec_id, frame_idx, label, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS probs FROM (SELECT vec_id // 50 AS rec_id, vec_id % 50 AS frame_idx, label, list_transform(embedding[1:10], lambda x: exp(8 * CAST(x AS DOUBLE))) AS e FROM embeddings)',
    "fx_targets": 'SELECT rec_id, frame_idx // 10 AS pos, label % 9 AS phone_id FROM fx_frames WHERE frame_idx % 10 = 0',
    "fx_words": 'SELECT user_id AS file_id, event_id AS word_id, event_type AS word, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS start, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE + 30.0 AS "end" FROM events',
    "fx_phone_intervals": 'SELECT file_id, word_id, k, substring(word, k + 1, 1) AS phone, start + 10.0 * k AS start, start + 10.0 * (k + 1) AS "end" FROM (SELECT *, unnest([0, 1, 2]) AS k FROM fx_words)',
    "fx_detect": "SELECT l_orderkey * 10 + l_linenumber AS rec, l_returnflag AS target, CASE l_linenumber % 4 WHEN 0 THEN 'N' WHEN 1 THEN l_returnflag ELSE substring('ANR', CAST(l_quantity AS INT) % 3 + 1, 1) END AS detection, l_linestatus AS status FROM lineitem",
}


def _used(text: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"(?:FROM|JOIN) {n}\b", text)]


def _table(spark: SparkSession, sf_dir: str, name: str, stored: dict[str, DataFrame]) -> DataFrame:
    if name in stored:
        return stored[name]
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK[name]
    text = text.replace("{", "{{").replace("}", "}}")
    used = _used(text, [*BASE, *SPARK])
    for n in used:
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **{n: _table(spark, sf_dir, n, stored) for n in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived one."""
    return _table(spark, sf_dir, name, {})


#: Derived tables that cost more to make than to store and read: texts cut to words, and what stands on their distinct words.
STORED = ("fx_tokens", "fx_syl", "fx_lexicon")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> list[DataFrame]:
    """Base and derived tables side by side; those of ``STORED`` are made once and stored where several of ``names`` stand on them."""
    out: dict[str, DataFrame] = {}
    for n in STORED:
        users = [m for m in names if n == m or n in _below(m)]
        if len(users) > 1 or (n in names and n != "fx_tokens" and len(names) > 1):
            out[n] = kept(_table(spark, sf_dir, n, out))
    return [_table(spark, sf_dir, n, out) for n in names]


def _below(name: str) -> set[str]:
    """Derived tables that a derived one stands on."""
    own = _used(SPARK.get(name, ""), list(SPARK))
    return {*own, *(m for n in own for m in _below(n))}


def duck(sql: str) -> str:
    """DuckDB SQL with the derived tables it names as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in DUCK:
            if re.search(rf"(?:FROM|JOIN) {n}\b", text) and n not in order:
                add(DUCK[n])
                order.append(n)

    add(sql)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({DUCK[n]})" for n in order)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
