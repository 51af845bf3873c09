"""Repeatable pseudo-randomness.

Every random choice is a function of (seed, row identity), so a result depends
neither on the partitioning nor on a task being run again after a lost executor.
"""
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed, *parts) -> Column:
    """md5 hex digest of ``seed:part:part…``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def uniform(seed, *parts) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the digest."""
    digits = F.substring(hash_hex(seed, *parts), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed, *parts) -> Column:
    """Standard normal number (Box-Muller on two digests)."""
    u1 = uniform(f"{seed}a", *parts)
    u2 = uniform(f"{seed}b", *parts)
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1))
    return radius * F.cos(F.lit(2.0 * math.pi) * u2)


def _col(part):
    return part if isinstance(part, Column) else F.col(part)
