"""A training corpus from the documents: filter, deduplicate, decontaminate, mask, encode.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before
has kept. All but the last return the columns of documents, whatever their names, except that they need
doc_id, text and - the last one - lang and source; n_chars follows the text where it is there.

A NULL or empty text is scored by the classifier like any other, alone in its class for the Jaccard join, never
contaminated, without secrets, and encoded as NULL or as no pieces. Texts of any length are used
whole. Rows with equal ids and texts are one document to the Jaccard join; NULL ids are documents of
their own, and share one key of the sampling. Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm import decontamination, jaccard, pieces, quality, secrets
from rasterweave.sources.settle import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents are long: this many in an Arrow batch, of which executors hold several at a time.
BATCH_ROWS = "1000"


def in_small_batches(stage: Stage) -> Stage:
    """The stage with the session's Arrow batches bounded, also for what it leaves to be run later."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 80 percent) the smallest id stays."""
    return jaccard.keep_first(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the number of characters follows."""
    masked = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids of a sampled segmentation of the text."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.vocabulary(), F.col("doc_id"))
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode),
]

# Classifier, random field and sampling have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what each keeps is stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
