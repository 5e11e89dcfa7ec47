"""The training-data pipeline: every stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelens.llm import decontaminate, line_dedup, mixing, ngram_join, quality_crf
from bytelens.llm.scratch import load, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_crf.keep_good(docs, load(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match no earlier line; documents of which nothing stays go."""
    return line_dedup.drop_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    return ngram_join.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with how often the mix takes each, and its words."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", new_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", clean_of_benchmark),
    ("source_mixing", mixed),
]

#: The first three stages (a trained classifier, similarity joins with components) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
    return docs
