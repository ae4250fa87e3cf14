"""Small derived tables and how they are joined.

A table derived by aggregation (classes, quotas, histograms) is cached and
counted once. Only when that count is within ``max_rows`` and its bytes (numbers, and
short codes of a set width) are within MAX_BROADCAST_BYTES is it broadcast; beyond that the
join is left to a shuffle join, where AQE's skew handling
splits hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 128 << 20
#: Bytes counted for a string column; class codes are shorter, and texts are never in such a table.
CODE_BYTES = 64


def row_bytes(df: DataFrame) -> int:
    return sum(CODE_BYTES if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema.fields)


@dataclass
class Dim:
    df: DataFrame
    rows: int
    max_rows: int = MAX_BROADCAST_ROWS

    @property
    def fits(self) -> bool:
        return self.rows <= self.max_rows and self.rows * row_bytes(self.df) <= MAX_BROADCAST_BYTES

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.fits else self.df


def checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> Dim:
    """Materialize a small derived table and record its size."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return Dim(df, df.count(), max_rows)


def bounded(df: DataFrame, rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> Dim:
    """A table whose row count is bounded by construction (e.g. one row per
    class of an already checked class table); no job is run."""
    return Dim(df, rows, max_rows)


def derive(dim: Dim, df: DataFrame, factor: int = 1) -> Dim:
    """A table derived from ``dim`` with at most ``factor`` rows per row of it."""
    return Dim(df, dim.rows * factor, dim.max_rows)


def join_dim(big: DataFrame, dim: Dim | DataFrame, on, how: str = "inner") -> DataFrame:
    if isinstance(dim, Dim):
        return big.join(dim.side(), on, how)
    return big.join(dim, on, how)
