"""Repeatable randomness from the keys of a row.

A draw depends on (seed, purpose, keys) only, never on row order, partitioning
or retries, so a lost executor recomputes exactly the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int, purpose: str, *keys: Column | str) -> Column:
    """32 hex digits for the given keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[p.cast("string") for p in parts]))


def _digits(hex_digits: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(hex_digits, start, length), 16, 10).cast("bigint")


def uniform(hex_digits: Column, start: int = 1) -> Column:
    """A double strictly between 0 and 1 from 13 hex digits."""
    return (_digits(hex_digits, start, 13).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def draw_int(hex_digits: Column, n: Column) -> Column:
    """An integer in ``0 .. n-1``; null where n is null or not positive."""
    return F.when(n > 0, _digits(hex_digits, 1, 13) % n)


def hash_bucket(hex_digits: Column, digits: int = 2) -> Column:
    """Leading digits as an integer: ordered like the hash itself."""
    return _digits(hex_digits, 1, digits)


def gaussian(hex_digits: Column) -> Column:
    """A standard normal draw (Box-Muller on two parts of the hash)."""
    u1, u2 = uniform(hex_digits, 1), uniform(hex_digits, 14)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)
