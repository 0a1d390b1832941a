"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes the rows that the one before it kept, and returns them with the
columns of documents; the last returns the mix, a row for each copy it takes.
All stages take columns beside those of documents, whatever their names, and
leave them out; nulls in any column, texts of any length and empty tables are
defined for each below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontam, line_dedup, mixing, near_dedup, quality
from netloom.llm.common import n_words, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and blank texts have fewer than ten words and go; repeated rows are judged alike; null ids, languages and sources play no part. Of an empty table nothing is kept."""
    return quality.judge(docs, COLUMNS).filter("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of lines and runs of lines. Documents of which no word is left are copies through and through; they go.

    The first copy is the one of the least id, nulls first; repeated rows are one document and are cut alike. Null, empty
    and blank texts have no lines and stay as they are. n_chars is counted anew where a text was cut.
    """
    cut = line_dedup.drop_repeated_lines(docs.select(*COLUMNS), with_longest=False)
    cut = cut.withColumn("n_chars", F.when(F.col("__nl_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.filter("__nl_removed < __nl_lines or __nl_removed = 0").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Null, empty and blank texts have no near-duplicates and stay. Rows with one id count as one document: all of them
    stay or go. Rows without an id stay unless their text is like one with an id.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__nl_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__nl_kept"]), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows and rows with null ids are judged by their texts; without a benchmark all stay."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, with size, copies and copy_no.

    A null source is one source, last in order. Null and empty texts have size 0. Rows equal in id, source and size count
    once when copies are dealt, and are taken alike. Of an empty table nothing is taken.
    """
    sizes = scratch(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).distinct(), "sizes")
    mixed = mixing.mix(sizes).filter("copies > 0").select(F.col("doc_id").alias("__nl_id"), F.col("source").alias("__nl_src"), F.col("size").alias("__nl_size"), "copies")
    both = docs.select(*COLUMNS, n_words(F.col("text")).alias("size"))
    cond = both["doc_id"].eqNullSafe(mixed["__nl_id"]) & both["source"].eqNullSafe(mixed["__nl_src"]) & (both["size"] == mixed["__nl_size"])
    taken = both.join(mixed, cond).withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*COLUMNS, "size", "copies", "copy_no")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
]

#: Estimating the rules' accuracies has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch(docs, f"stage-{i + 1}")
    return docs
