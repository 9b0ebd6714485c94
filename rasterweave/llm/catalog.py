"""Queries of this subpackage over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rasterweave.llm import sql
from rasterweave.llm import (
    archives, decontamination, jaccard, language, licenses, merkle, neighbours, pieces, quality, secrets, substrings, tries, urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digest(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.digest(table(spark, sf_dir, "conversations"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.digest(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_substrings": op2_substrings,
    "op3_jaccard": op3_jaccard,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_language": op7_language,
    "op8_neighbours": op8_neighbours,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_trie": op11_trie,
    "op12_manifest": op12_manifest,
    "op13_warc": op13_warc,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op1_decontamination": sql.OP1,
    "op2_substrings": sql.OP2,
    "op3_jaccard": sql.OP3,
    "op4_urls": sql.op4(),
    "op10_licenses": sql.op10(),
    "op11_trie": sql.OP11,
    "op12_manifest": sql.OP12,
    "op13_warc": sql.OP13,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
