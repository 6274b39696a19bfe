"""Seeded randomness as a pure function of a row id.

The draw for a row depends on the seed and its id only, so it does not change with
partitioning, retries or executor loss, and plain SQL can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def rnd(seed, *ids: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of md5('seed|id|...'), all of which a double holds."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [first, *[i.cast("string") for i in ids]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def fast_uniform(seed: int, *ids: Column) -> Column:
    """Uniform in (0, 1) from xxhash64; for generated rows, where no SQL has to agree."""
    h = F.xxhash64(F.lit(seed), *ids)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def fast_normal(seed: int, *ids: Column) -> Column:
    """Standard normal by Box-Muller over two hashed uniforms."""
    radius = F.sqrt(-2.0 * F.log(fast_uniform(seed, F.lit(0), *ids)))
    return radius * F.cos(2.0 * F.pi() * fast_uniform(seed, F.lit(1), *ids))
