"""Randomness from hashes: the same key gives the same number on any engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by a bar."""
    key = F.md5(F.concat_ws("|", *(F.col(p) if isinstance(p, str) else p for p in parts)))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column | str) -> Column:
    """A standard normal number, by Box and Muller from two uniforms."""
    u = F.greatest(uniform(*parts, F.lit("a")), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*parts, F.lit("b")))


def r6(c: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
