"""Which rows can find a partner at all: a Bloom filter of the other side's keys.

Rows that it turns away have no partner; of the others without one it lets about one in fifty through, which
the join after it tells. Its bits are laid out slice by slice on the executors (a task holds its slices, not
the whole), and their number is that of the keys times BITS up to MAX_BITS, above which it only lets
more rows through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from strata.llm.common import give_back

#: Bits a key, of the whole filter at most (128 MB) and of a slice.
BITS, MAX_BITS, SLICE = 16, 1 << 30, 1 << 20


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits a hash, from its halves: (2, n)."""
    h = hashes.astype(np.int64).view(np.uint64)
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def member_filter(hashes: DataFrame, rows: int) -> Callable[[Column], Column]:
    """``hashes``: one long column of about ``rows`` rows. Returns a condition on a long column that is true for all of them."""
    bits = min(MAX_BITS, max(SLICE, 1 << max(0, BITS * rows - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(_places(b.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((p // SLICE).astype(np.int32)), pa.array((p % SLICE).astype(np.int32))], names=["slice", "place"])
        give_back()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for k in np.unique(at).tolist():
                held.setdefault(k, np.zeros(SLICE, bool))[place[at == k]] = True
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])
        held.clear()
        give_back()

    whole = np.zeros(bits // 8, np.uint8)
    for k, v in hashes.mapInArrow(places, "slice int, place int").repartition("slice").mapInArrow(packed, "slice int, bits binary").collect():
        whole[k * (SLICE // 8) : (k + 1) * (SLICE // 8)] = np.frombuffer(v, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(whole)

    @F.arrow_udf(BooleanType())
    def holds(h: pa.Array) -> pa.Array:
        p = _places(h.to_numpy(zero_copy_only=False), bits)
        return pa.array(((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0))

    return holds
