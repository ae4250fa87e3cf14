"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

os.environ.setdefault("OMP_NUM_THREADS", "1")


#: Bytes of a record batch that a function gets at a time.
PART_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def in_parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch of about PART_BYTES each, at least one row."""
    step = max(1, b.num_rows * PART_BYTES // max(b.nbytes, 1))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one record batch; batches are cut into parts of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in in_parts(b):
                out = fn(part)
                if out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (id, text): whatever other columns a table carries cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parts_for(df: DataFrame, amount: int, per_part: int) -> int:
    """Partitions for an amount (rows, bytes) at ``per_part`` each, at least the session's shuffle width."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // per_part))
