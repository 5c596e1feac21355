"""A training-corpus pipeline: toxicity, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents``. Between stages the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import line_dedup, mixing, ngram_join, packing, toxicity
from casemill.llm.catalogue import tokenizer_path
from casemill.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the lexicon is learned from the labelled ones.

    Null and empty texts score as texts without hits and stay, repeated rows are scored each; equal scores are judged
    alike. Without labels the fixed terms decide. An empty table gives no rows; all columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go; a document all of whose lines went goes too; n_chars follows.

    Null and empty texts have no lines and stay; a line that several rows hold stays in the one with the smallest id
    (null first), rows that repeat an id and a text are treated alike. An empty table gives no rows.
    """
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("__removed") > 0) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) == 0)
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    chars = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five words and a similarity of 0.8, the one with the smallest id stays.

    Null, empty and blank texts link with nothing and stay; rows that repeat both id and text leave one. An empty table
    gives no rows; all columns pass through.
    """
    return ngram_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate says.

    Null and empty texts have size 0 and are drawn like others, null sources are one source, repeated rows draw alike,
    rows with a null id by their text. An empty table gives no rows; all columns pass through.
    """
    return mixing.emitted(mixing.mixed(docs)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens.

    Null and empty texts are the end id alone, null ids are kept, repeated rows are packed each. An empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path("bytes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express the learned lexicon, the edit distance join or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
