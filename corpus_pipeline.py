"""Corpus preparation: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.decontamination import decontaminate
from driftline.llm.line_dedup import dedup_lines
from driftline.llm.ngram_join import Rule, keep_first
from driftline.llm.packing import pack
from driftline.llm.tables import forget
from driftline.llm.toxicity import keep_clean
from driftline.llm.words import batches_of
from driftline.session import materialize, table

#: Near-copies: five-word shingles, similarity 0.8 or more.
NEAR = Rule(words=5, percent=80)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is like go, and documents that had lines and keep none."""
    found = dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = [F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-copies the document with the smallest id stays."""
    return keep_first(docs, rule=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; ``tokens`` are the ids."""
    return pack(docs).withColumnRenamed("ids", "tokens")


STAGES = (
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
)

#: The toxicity model and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            forget(spark)
    return docs
