"""Places of rows in a sorted order, and joins on keys that may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.sources.settle import settle

#: A key with more than one in so many of the left rows counts as hot; there are at most as many hot keys.
HOT_KEYS = 10_000


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``idx``, the place of each row in its group from 0, and ``n``, the rows of the group.

    Rows are sorted by range over all tasks, whatever the size of a group, and stored;
    what a task holds of a group is one row of a small table of offsets. ``order`` must leave
    no large sets of equal rows.
    """
    placed = settle(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    within = Window.partitionBy(group)
    before = F.sum("_rows").over(within.orderBy("_part")) - F.col("_rows")
    offsets = parts.select(
        group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(within).alias("n")
    )
    return placed.join(offsets, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, in which ``right`` is unique and ``left`` may hold one value very often.

    Values with more than 1 / HOT_KEYS of the left rows are at most HOT_KEYS, so their rows
    of ``right`` are sent to all; the others are shuffled, and none of them is large.
    ``left`` is read three times: hand over a stored table.
    """
    counts = settle(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter((F.col("_n") > total / HOT_KEYS) & F.col(key).isNotNull()).select(key)
    sent = F.broadcast(settle(right.join(hot, key, "left_semi").withColumn("_hot", F.lit(True))))
    marked = left.join(sent, key, "left")
    columns = [c for c in marked.columns if c != "_hot"]
    return (
        marked.filter("_hot").select(columns)
        .union(marked.filter("_hot is null").select(left.columns).join(right, key, how).select(columns))
    )
