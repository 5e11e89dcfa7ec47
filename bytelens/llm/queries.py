"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scratch import load


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import report

    return report(load(spark, sf_dir, "documents"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import report

    return report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unit_dedup import remove_later

    return remove_later(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(load(spark, sf_dir, "documents"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_lm import score

    return score(load(spark, sf_dir, "documents"))


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_sequences import report

    return report(load(spark, sf_dir, "documents"))


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_collapse import collapse

    return collapse(load(spark, sf_dir, "conversations"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import components_of

    return components_of(load(spark, sf_dir, "documents"), 4, (85, 100))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(load(spark, sf_dir, "documents")).drop("source")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_crf, op3_unit_dedup, op4_line_dedup, op5_pseudo_likelihood, op6_media_sequences, op7_chat_collapse, op8_ngram_jaccard, op9_decontaminate, op10_mix_sources)}
