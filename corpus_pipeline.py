"""Cleaning a corpus for training: quality, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.llm import decontaminate, line_dedup, near_dup, packing, quality_model
from citegrid.llm.native import NOT_BLANK
from citegrid.llm.shared import cut, small_batches, table, without_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad or toxic go.

    Null and empty texts are judged by their statistics and site; rows with a null id stay; rows that share an id go together.
    Without labels, and of an empty table, nothing goes. Extra columns stay, whatever their names.
    """
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines leave the texts; every document stays, and n_chars follows its text.

    Null texts stay null (and n_chars as it is), rows with a null id keep their lines, repeated rows are one document; of equal
    lines those of the least id stay. Extra columns stay, whatever their names.
    """
    cleaned = line_dedup.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])  # without the last column, the spans
    length = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")) if "n_chars" in docs.columns else None
    return cleaned if length is None else cleaned.withColumn("n_chars", length).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; one that line dedup has emptied is a copy too.

    Texts that had no words from the start stay, as do rows with a null id; rows that share an id stay or go together. Extra
    columns stay, whatever their names.
    """
    small_batches(spark)
    wordless = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(NOT_BLANK)
    had_words = table(spark, sf_dir, "documents").filter(~wordless("text")).select("doc_id")
    emptied = docs.filter(wordless("text")).select("doc_id").join(had_words, "doc_id", "left_semi")
    return without_ids(near_dup.keep_one(docs), emptied, "doc_id")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and rows with a null id stay; rows that share an id go together. Without items, and of an empty
    table, nothing goes. Extra columns stay, whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that are left, as pieces of token sequences.

    Null and empty texts are one piece with the end id; null ids stay null; repeated rows are packed as often as they occur.
    Only the id and the text are read. An empty table gives no pieces.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", leaks),
    ("packing", packed),
]

#: A trained classifier and a tokenizer have no counterpart in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
