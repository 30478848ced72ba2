"""The query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from opinara.llm import (
    alignment,
    conversations,
    decontaminate,
    html_text,
    jaccard,
    language_id,
    licenses,
    pieces,
    quality,
    quality_rules,
    repeats,
    training_order,
    vectors,
)
from opinara.llm.common import fold, shared_folder, stored

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_MARK = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pieces.digests(docs, pieces.read_model(PIECE_MODEL))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = quality.fit(docs, labels)
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), ["doc_id"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.strip(docs, repeats.find_repeats(docs)).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                              ["doc_id"])


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written to the shared folder, and read back for their digests."""
    folder = shared_folder(spark, "shards")
    manifest = training_order.write_shards(_table(spark, sf_dir, "documents"), folder,
                                           training_order.read_ranks(RANKS), public_tokenizers.PATTERN, END_MARK)
    return training_order.read_back(stored(manifest, "manifest"), folder)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return jaccard.near_duplicates(docs, n=3, threshold=(90, 100)).select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull())
    model = language_id.fit(learn.select("doc_id", "text", "lang"))
    return language_id.predict(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(1)).alias("base_failed"), quality_rules.passes().alias("kept"), "failed")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.Files.read(BYTE_LEVEL, PIECE_MODEL)
    return alignment.align(_table(spark, sf_dir, "documents"), files, ["doc_id"])


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_training_order": op6_training_order,
    "op7_html_text": op7_html_text,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_language_id": op9_language_id,
    "op10_vectors": op10_vectors,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {
    "op3_licenses": licenses.oracle(),
    "op4_substring_dedup": repeats.oracle(),
    "op8_ngram_jaccard": jaccard.oracle(3, (90, 100)),
    "op11_quality_rules": quality_rules.oracle(),
}
