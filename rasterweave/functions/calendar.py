"""Dates, positions in time and sample paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterweave.functions.grids import bind

# --- fixed values -----------------------------------------------------------
REFERENCE_DATE = "2015-06-23"
FRAME_STEP_DAYS = 5
FIRST_FRAME_OFFSET_DAYS = 4
# ----------------------------------------------------------------------------


def day_of_year(day: Column) -> Column:
    """1 January is 0."""
    return F.dayofyear(day) - F.lit(1)


def days_since_reference(day: Column) -> Column:
    return F.datediff(day, F.lit(REFERENCE_DATE).cast("date"))


def sample_stem(path: Column) -> Column:
    """``<tile>/<stem>`` of a cube file, without the ``context_``/``target_`` marker."""
    bare = F.regexp_replace(F.substring_index(path, "/", -2), r"(^|/)(context_|target_)", "$1")
    return F.regexp_replace(bare, r"\.[^./]*$", "")


def tile_of(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def frame_dates(stem: Column) -> Column:
    """Acquisition dates of a sequence from the start and end date in its name.

    The first frame lies ``FIRST_FRAME_OFFSET_DAYS`` after the start date; a name
    whose range is shorter than that offset has no frames.
    """
    parts = F.split(F.element_at(F.split(stem, "/"), -1), "_")
    first = F.date_add(F.to_date(F.get(parts, F.lit(1))), FIRST_FRAME_OFFSET_DAYS)
    last = F.to_date(F.get(parts, F.lit(2)))

    def dates(span: Column) -> Column:
        n = F.floor(F.datediff(span["last"], span["first"]) / FRAME_STEP_DAYS).cast("int")
        steps = F.sequence(F.lit(0), n)
        return F.when(
            span["first"] <= span["last"],
            F.transform(steps, lambda i: F.date_add(span["first"], i * FRAME_STEP_DAYS)),
        ).otherwise(F.array().cast("array<date>"))

    return bind(F.struct(first.alias("first"), last.alias("last")), dates)
