"""Ordered scans along a key that stay balanced when one key is very long.

A plain window puts all rows of a key into one task. Here ``block`` - an integer
expression that never decreases along the order - cuts a key into parts: rows are
shuffled and sorted by (key, block), one small summary row per block is scanned
along the key, and its result is joined back. The summary is aggregated before it
is shuffled, so the rows move once. Without ``block``, for keys whose rows are known to
fit a task - the frames of one pixel - neighbours are found by one plain scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALL_BEFORE = Window.unboundedPreceding


#: Rows of a key that one task scans, unless the caller says otherwise.
BLOCK_ROWS = 65_536


def blocks_of(column: str, size: int = BLOCK_ROWS) -> Column:
    """Block number of a dense index."""
    return F.floor(F.col(column) / F.lit(size)).cast("bigint")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    visible: Column,
    payload: Sequence[str],
    *,
    prev: str | None = "prev",
    next: str | None = "next",
    inclusive: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """Add the nearest visible row before and after each row, as structs.

    ``prev`` is the latest row with ``visible`` true at or before the current one,
    ``next`` the earliest at or after it (strictly before / after if not
    ``inclusive``). The struct holds ``payload``. Both sides share one exchange.
    """
    keys = list(keys)
    part = keys if block is None else [*keys, "_block"]
    upto = 0 if inclusive else -1
    asc = [F.col(c).asc() for c in order]
    desc = [F.col(c).desc() for c in order]
    rows = df.withColumn("_seen", F.when(visible, F.struct(*[F.col(c) for c in payload])))
    if block is not None:
        rows = rows.withColumn("_block", block)

    out = rows
    for name, direction in ((prev, asc), (next, desc)):
        if name:
            w = Window.partitionBy(*part).orderBy(*direction).rowsBetween(_ALL_BEFORE, upto)
            out = out.withColumn(name, F.last("_seen", ignorenulls=True).over(w))
    if block is None:
        return out.drop("_seen")

    # Rows that are not visible have no place, and max_by / min_by pass them over.
    place = F.when(F.col("_seen").isNotNull(), F.struct(*[F.col(c) for c in order]))
    blocks = rows.groupBy(*part).agg(
        F.max_by("_seen", place).alias("_tail"), F.min_by("_seen", place).alias("_head")
    )
    across = Window.partitionBy(*keys)
    carry = blocks.select(
        *part,
        F.last("_tail", ignorenulls=True)
        .over(across.orderBy(F.col("_block").asc()).rowsBetween(_ALL_BEFORE, -1))
        .alias("_before"),
        F.last("_head", ignorenulls=True)
        .over(across.orderBy(F.col("_block").desc()).rowsBetween(_ALL_BEFORE, -1))
        .alias("_after"),
    )
    out = out.join(carry, part)
    if prev:
        out = out.withColumn(prev, F.coalesce(F.col(prev), F.col("_before")))
    if next:
        out = out.withColumn(next, F.coalesce(F.col(next), F.col("_after")))
    return out.drop("_seen", "_block", "_before", "_after")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    *,
    block: Column,
) -> DataFrame:
    """Add a 0-based row number per key, as BIGINT."""
    keys = list(keys)
    part = [*keys, "_block"]
    rows = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(_ALL_BEFORE, -1)
    offsets = (
        rows.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        rows.withColumn("_inside", inside)
        .join(offsets, part)
        .withColumn(name, (F.col("_offset") + F.col("_inside") - 1).cast("bigint"))
        .drop("_block", "_inside", "_offset")
    )


def with_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``n_frames``, the rows of each key, unless it is there: a map-side combined count, joined."""
    if "n_frames" in df.columns:
        return df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    return df.join(sizes, list(keys))


def runs(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    member: Column,
    linked: Callable[[Column, Column], Column],
    payload: Sequence[str] = (),
    *,
    block: Column,
) -> DataFrame:
    """Maximal runs of member rows: (keys, run_start, run_end, run_len).

    ``linked(row, before)`` decides from a member and its predecessor among the members (structs
    of ``t`` and ``payload``) whether the run goes on. A key without members has one row with NULL
    bounds and length 0, so that none is lost and no join is needed to bring it back.

    Rows are shuffled once. A block's members are one sorted array, cut into its runs in place; of each block only the first and the last
    run can go on elsewhere, and only these are looked at along the key.
    """
    keys = list(keys)
    entry = F.when(member, F.struct(F.col(t), *[F.col(p) for p in payload]))
    blocks = df.groupBy(*keys, block.alias("_block")).agg(F.array_sort(F.collect_list(entry)).alias("_m"))

    def opens(x: Column, i: Column) -> Column:
        return (i == 0) | F.coalesce(~linked(x, F.get(F.col("_m"), i - 1)), F.lit(True))

    first = F.filter(F.transform("_m", lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull())
    cut = blocks.withColumn("_first", first)

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_first"), k + 1), F.size("_m")) - 1
        return F.struct(
            F.get(F.col("_m"), start).alias("head"), F.get(F.col("_m"), end).alias("tail"),
            (end - start + 1).cast("bigint").alias("len"), ((k == 0) | (k == F.size("_first") - 1)).alias("edge"), (k == 0).alias("opening"),
        )

    # An outer explode leaves a row of a block without members: its key is not lost.
    each = cut.select(*keys, "_block", F.explode_outer(F.transform("_first", run)).alias("_r")).select(*keys, "_block", "_r.*")
    bounds = [F.col(f"head.{t}").alias("run_start"), F.col(f"tail.{t}").alias("run_end"), F.coalesce("len", F.lit(0).cast("bigint")).alias("run_len")]

    edges = each.where("edge is null or edge")
    order = Window.partitionBy(*keys).orderBy("_block", F.col("opening").desc_nulls_last())
    # Blocks without members have no say in whether a run goes on.
    before = F.last("tail", ignorenulls=True).over(order.rowsBetween(_ALL_BEFORE, -1))
    fresh = F.when(F.col("head").isNotNull(), ~F.col("opening") | F.col("before").isNull() | F.coalesce(~linked(F.col("head"), F.col("before")), F.lit(True)))
    numbered = edges.withColumn("before", before).withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(0)))
    numbered = numbered.withColumn("_no", F.when(F.col("head").isNotNull(), F.sum("_new").over(order.rowsBetween(_ALL_BEFORE, 0))))
    joined = numbered.groupBy(*keys, "_no").agg(
        F.min(f"head.{t}").alias("run_start"), F.max(f"tail.{t}").alias("run_end"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("run_len")
    )
    inner = each.where("not edge").select(*keys, *bounds)
    return inner.unionByName(joined.drop("_no"))
