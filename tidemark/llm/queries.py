"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    fim,
    idfile,
    language,
    linecrf,
    merkle,
    mixing,
    neighbours,
    packing,
    pii,
    quality,
    simhash,
    suffixtree,
    toxicity,
)
from tidemark.llm.batches import fold
from tidemark.llm.tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to target weights that flatten the sources' sizes, shuffled."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the suffix tree and the unigram base."""
    scored = suffixtree.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every query vector."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op7_ranked_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in the binary format and read back."""
    return idfile.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by format-preserving pseudonyms."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs)).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op12_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled rows outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = linecrf.fit(docs, _table(spark, sf_dir, "labels"))
    return linecrf.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle form and of the text rebuilt from it."""
    cut = fim.transform(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_suffix_tree_scoring,
        op3_simhash_near_dedup,
        op4_toxicity,
        op5_quality_rules,
        op6_permutation_index,
        op7_ranked_id_files,
        op8_pii_pseudonyms,
        op9_sum_of_squares_packing,
        op10_language_id,
        op11_merkle_manifest,
        op12_line_field_quality,
        op13_fill_in_middle,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.mix_sql(),
    "op5_quality_rules": quality.judge_sql(),
    "op11_merkle_manifest": merkle.audit_sql(),
    "op13_fill_in_middle": fim.transform_sql(),
}
