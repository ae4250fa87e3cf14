"""Seeded, engine-independent draws.

Every random choice is a function of (seed, salt..., id) through md5, so it is
stable under recomputation (a lost task redraws the same values), does not
depend on partitioning, and can be reproduced in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def seed_key(seed, *parts) -> Column:
    """md5 hex of 'seed:part1:part2...' (parts are columns or literals)."""
    return F.md5(F.concat_ws(":", _c(seed), *[_c(p) for p in parts]))


def draw(seed, *parts) -> Column:
    """H(x): the first 15 hex digits of the md5 key as a BIGINT in [0, 2^60)."""
    return F.conv(F.substring(seed_key(seed, *parts), 1, 15), 16, 10).cast("bigint")


def bucket_of(key: Column, digits: int = 3) -> Column:
    """Leading hex digits of a key; ordering buckets orders keys."""
    return F.substring(key, 1, digits)
