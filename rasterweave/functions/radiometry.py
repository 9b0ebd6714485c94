"""Value scaling, band choice and composites, for scalars and for band arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
OPTICAL_RANGE = (0.0, 10000.0)
RADAR_DB_RANGE = (-25.0, 0.0)
# ----------------------------------------------------------------------------


def per_pixel(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Lift a scalar expression to a band array."""
    return lambda band: F.transform(band, fn)


def clip(v: Column, low: float, high: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def missing_to_null(v: Column) -> Column:
    """NaN marks a missing reflectance on disk; tables hold NULL instead."""
    return F.when(~F.isnan(v), v)


def clean_reflectance(v: Column) -> Column:
    """Missing becomes 0, the rest is clipped to [0, 1]."""
    v = v.cast("double")
    return clip(F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)), 0.0, 1.0)


def rescale(v: Column, low: float, high: float) -> Column:
    return (clip(v.cast("double"), low, high) - F.lit(low)) / F.lit(high - low)


def scale_optical(v: Column) -> Column:
    return rescale(v, *OPTICAL_RANGE)


def scale_radar(v: Column) -> Column:
    return rescale(v, *RADAR_DB_RANGE)


def percent_to_fraction(v: Column) -> Column:
    return v / F.lit(100.0)


def fraction_to_percent(v: Column) -> Column:
    return v * F.lit(100.0)


def apply_brightness(v: Column, factor: float = 3.0) -> Column:
    """Brighter, up to 1; a missing value stays missing."""
    return F.when(v.isNotNull(), F.least(F.lit(1.0), v * F.lit(factor)))


def band_vector(columns: list[str]) -> Column:
    """Per-pixel bands as one array, in the given order."""
    return F.array(*[F.col(c) for c in columns])


def false_color(bands: Column, rgb: tuple[int, int, int], nir: int) -> Column:
    """(NIR, R, G) from a per-pixel band array; positions are 0-based."""
    pick = [nir, rgb[0], rgb[1]]
    return F.array(*[F.element_at(bands, i + 1) for i in pick])


def output_positions(channels: str) -> tuple[tuple[int, int, int], int | None]:
    """(positions of R, G, B; position of NIR or None) within a channel set."""
    if channels == "rgb":
        return (0, 1, 2), None
    if channels.startswith("all"):
        return (3, 2, 1), 7
    return (2, 1, 0), 3 if "-nir" in channels else None
