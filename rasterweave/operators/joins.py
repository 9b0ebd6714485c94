"""Equi-joins whose left side may hold one key very often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    rows_per_copy: int = 100_000,
) -> DataFrame:
    """Join with hot left keys split into parts and their right rows copied per part.

    Keys with at most ``rows_per_copy`` left rows get one part, so nothing is copied
    for them. The left counts are combined map-side; there are at most
    ``rows / rows_per_copy`` hot keys, and whether that table is broadcast is
    left to the optimizer's size check. ``right`` must be unique in ``on``.
    """
    on = list(on)
    hot = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_copy)
        .select(*on, F.ceil(F.col("_rows") / rows_per_copy).cast("int").alias("_parts"))
    )
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_parts"), F.lit(1)))
    split = left.join(hot, on, "left").withColumn("_part", part.cast("int")).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    copied = right.join(hot, on, "left").withColumn("_part", F.explode(copies)).drop("_parts")
    return split.join(copied, [*on, "_part"], how).drop("_part")
