"""The registered queries of this package: thin views of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hard_negatives, html_text, importance, language_id, line_dedup, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_counts
from .common import n_words, scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(scratch(sized, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return cut.select("doc_id", F.col("__nl_lines").alias("n_lines"), F.col("__nl_removed").alias("n_removed"), F.col("__nl_longest").alias("longest_run"), digest.alias("kept_sha256"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"), with_kept=False)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_minhash_near_dedup,
        op3_chat_formatting,
        op4_html_extraction,
        op5_decontamination,
        op6_source_mixing,
        op7_substring_dedup,
        op8_token_counts,
        op9_language_id,
        op10_line_dedup,
        op11_hard_negative_mining,
        op12_suffix_array_dedup,
        op13_importance_resampling,
    )
}

#: Estimation, page rendering, tokenising and compression have no SQL form; their tests hold them against brute force, round trips or labels.
ORACLES = {
    "op2_minhash_near_dedup": near_dedup.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_hard_negative_mining": hard_negatives.ORACLE,
    "op12_suffix_array_dedup": suffix_dedup.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
