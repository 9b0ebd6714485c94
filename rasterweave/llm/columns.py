"""Names for columns that an operator adds for its own use, and settings of the jobs run within a block."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LATE_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in the Arrow batches of the jobs run within.

    Of batches of whole documents, the executor and the Python worker hold several copies.
    """
    with _set(spark, _BATCH, str(rows)):
        yield


@contextmanager
def no_late_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins of the jobs run within stay as planned when their sides have been shuffled and one turns out small.

    To broadcast it then, the driver takes it in by one more task for each partition, and holds it and the
    new plan. Tables that are known to be small are broadcast as before.
    """
    with _set(spark, _LATE_BROADCAST, "-1"):
        yield


def unused(df: DataFrame, stem: str) -> str:
    """``stem``, or it with underscores after it, whichever no column has."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
