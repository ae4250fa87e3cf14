"""De-duplication as one hash aggregate.

``groupBy(keys)`` does a map-side partial aggregate before the shuffle, so a key
shared by a third of the rows collapses to one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strata.functions.text import CODE_COLS, TEXT_COLS

DEDUP_KEYS = (*CODE_COLS, *TEXT_COLS)


def dedup_exact(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, id_col: str = "id") -> DataFrame:
    """keep='first': one row per key, the one with the lowest id."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys and c != id_col]
    aggs = [F.min(id_col).alias(id_col)]
    if others:
        aggs.append(F.min_by(F.struct(*others), F.col(id_col)).alias("_rest"))
    out = df.groupBy(*keys).agg(*aggs)
    if others:
        out = out.select(*keys, id_col, "_rest.*")
    return out.select(*df.columns)


def dedup_none(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, id_col: str = "id") -> DataFrame:
    """keep=False: drop every key that occurs more than once."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys and c != id_col]
    aggs = [F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("_n")]
    if others:
        aggs.append(F.min_by(F.struct(*others), F.col(id_col)).alias("_rest"))
    out = df.groupBy(*keys).agg(*aggs).filter(F.col("_n") == 1)
    if others:
        out = out.select(*keys, id_col, "_rest.*")
    return out.select(*df.columns)
