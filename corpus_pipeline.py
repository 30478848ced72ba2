"""The corpus pipeline: five operators applied to `documents`, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last give the columns of
docs, with rows or words left out; the last gives one row of token figures for each document. Empty
and null texts pass every filter but the first, which rejects texts without a letter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import decontaminate, jaccard, language_id, pieces, repeats
from opinara.llm.common import fold, replaced


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; learned from the rows that name one."""
    learn = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull())
    return language_id.accepted(docs, language_id.fit(learn.select("doc_id", "text", "lang")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near-duplicates (five words, 0.8)."""
    found = jaccard.near_duplicates(docs)
    gone = found.where("component < doc").select(
        F.col("doc").alias("__doc"), F.col("body").alias("__body")).distinct()
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("bigint"), "__body": F.xxhash64("text")})
    return keyed.join(gone, ["__doc", "__body"], "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a document with a smaller doc_id holds as well."""
    columns = docs.columns
    cut = repeats.strip(docs, repeats.find_repeats(docs))
    cut = cut.toDF(*columns, "__kept", "__words", "__removed")
    changed = F.col("__removed") > 0
    new = {"text": F.when(changed, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars"))
    return cut.withColumns(new).select(columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token figures of each document after encoding with merge-dropout and decoding."""
    return pieces.digests(docs, pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

# Language identification and the keyed hashes of the encoder have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each gives is stored before the next one reads it, and removed when
    that one's result is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = before = replaced(stage(spark, docs, sf_dir), name, before)
    return STAGES[-1][1](spark, docs, sf_dir)
