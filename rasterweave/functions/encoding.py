"""Sinusoidal features of a position in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positional_features(
    position: Column, d: int, period: float = 1000.0, repeat: int | None = None, offset: int = 0
) -> Column:
    """``d`` features: sine at even, cosine at odd positions; repeated per head."""

    def feature(i: int) -> Column:
        scale = period ** (2.0 * ((i + offset) // 2) / d)
        angle = position.cast("double") / F.lit(scale)
        return F.sin(angle) if i % 2 == 0 else F.cos(angle)

    block = F.array(*[feature(i) for i in range(d)])
    return F.flatten(F.array_repeat(block, repeat)) if repeat else block
