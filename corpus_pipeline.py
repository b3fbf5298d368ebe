"""A training-data pipeline over ``documents``: five stages, each one of the corpus operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``:

1. language ID: documents without a determined language go: null, without a letter, or with a pooled score of the
   network under ``LEAST_SHARES`` even ones; without a model (no training row has a language) all with a letter stay;
2. line dedup: later repeated runs of lines are deleted from texts (``n_chars`` follows); a document
   of which nothing but blanks is left goes;
3. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays;
4. benchmark decontamination: documents in which a window of a benchmark item occurs go;
5. SentencePiece encoding and decoding: sizes and checksums of the ids, checked by decoding.

Nulls, empty texts, repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlab.llm import decontaminate, jaccard, language, line_dedup, pieces
from speechlab.llm._common import free_name, held_out, stored
from speechlab.llm.queries import tokenizer_file


#: A document is in no language if its best one's share of its positions' probability is under this many even shares
#: (of four languages: under 0.3125; the least share of 1,000 documents at sf0.01 was 0.468, rightly labelled).
LEAST_SHARES = 1.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(~held_out("doc_id", 4, 2)))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    floor = LEAST_SHARES / len(model.languages) if len(model.languages) > 1 else 0.0
    placed = free_name(docs.columns, "placed")
    # the other columns stay beside the text that goes to the network; nothing is sent back but its result
    found = docs.where(F.col("text").rlike(r"\p{L}")).withColumn(placed, language.predictions(docs, model))
    return found.where(F.col(f"{placed}.pooled") >= floor).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_runs(docs)
    deleted = F.col(free_name(docs.columns, "lines_deleted"))
    left = (deleted == 0) | F.col("text").rlike(r"\S")
    n_chars = F.when(deleted > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
