"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlab.llm import decontaminate, importance, jaccard, knn, language, line_dedup, pieces, prefix_trie, quality, secrets, sql, token_counts, token_files, toxicity
from speechlab.llm._common import held_out, shared_dir, stored


def tokenizer_file(name: str) -> str:
    """Path of an installed public tokenizer file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = knn.quantised(_read(spark, sf_dir, "embeddings"))
    return knn.top_k(data, data.where("id % 20 = 0"), 20)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    manifest = token_files.write(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder, end_id=2)
    return token_files.read(manifest, folder)


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality.classify(docs, labels, held_out("doc_id", 4, 2))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets.scan(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def count(kind):
        return F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")


    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = text(F.filter("found", lambda x: x.kind != "token"))
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), text(F.col("found")).alias("spans"), count("token"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 4, 2)
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", out)
    return language.label(docs, language.fit(docs.where("not held_out")), ["doc_id", "held_out"])


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels, held_out("doc_id", 5, 0))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents")).drop("t")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines", "lines_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, least_words=20, seed=2024)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(prefix_trie.numbered_turns(_read(spark, sf_dir, "conversations")), "turns")
    c = F.col("conv_id")
    sizes, rebuilt = prefix_trie.grafted(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5, 8)
    return prefix_trie.trie(sizes, rebuilt)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_voronoi_knn, op2_token_files, op3_quality_nbsvm, op4_secret_scan, op5_decontaminate, op6_sentencepiece, op7_language_id, op8_toxic_segments, op9_ngram_jaccard, op10_line_dedup, op11_importance_resampling, op12_prefix_trie, op13_token_counts)
}
#: The other operators are models, tokenizers or patterns with places, which SQL cannot state.
ORACLES: dict[str, str] = {
    "op1_voronoi_knn": sql.VORONOI_KNN,
    "op5_decontaminate": sql.DECONTAMINATE,
    "op9_ngram_jaccard": sql.NGRAM_JACCARD,
    "op10_line_dedup": sql.LINE_DEDUP,
    "op11_importance_resampling": sql.IMPORTANCE,
    "op12_prefix_trie": sql.PREFIX_TRIE,
}
