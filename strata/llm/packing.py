"""Best-fit packing of documents into sequences by vectors of capacities.

A piece takes three amounts of a sequence: tokens, one document, and attention cost (the
square of its length). A piece goes to the open sequence that holds it in every component
and whose residuals match it best: the largest weighted dot product of piece and residual,
or the least weighted norm of what would remain. Pieces come in decreasing length.

Whole pieces (as long as a sequence) need no choice. The others are dealt by a hash into
groups of a set number of pieces, each packed by itself, so that a group is one bounded
task whatever the corpus; a group leaves at most about one sequence half empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import id_text, map_arrow
from strata.llm.tokens import CLOSE_ID, encode_json
from strata.session import persist_table

LENGTH = 2048
#: Documents of one sequence at most, and their attention cost (never above the square of the length).
MAX_DOCUMENTS, MAX_COST = 2048, LENGTH * LENGTH
#: Weights of tokens, documents and cost in the choice.
WEIGHTS = (1.0, 0.02, 0.02)
#: Pieces packed together.
GROUP = 8_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the sequence."""
    first = n % length or length
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """documents -> pieces, each document closed by id 0: place in the document, length,
    CRC-32 and (unless told otherwise) the ids themselves.

    A null text is empty: one piece with the closing id alone. Repeated rows give repeated pieces.
    """
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.append(encode_json(vocabulary, t.as_py() or ""), np.uint32(CLOSE_ID))
            for k, (s, n) in enumerate(cut_points(len(x), length)):
                rows.append((i, k, s, n, crc32(x[s : s + n])))
            if with_ids:
                ids.append(x.astype(np.int32))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        if not with_ids:
            return pa.RecordBatch.from_arrays(cols, names=names)
        ends = np.concatenate([[0], np.cumsum([r[3] for r in rows])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[*names, "ids"])

    return map_arrow(id_text(docs), one, PIECES + (", ids array<int>" if with_ids else ""))


def pack_group(lengths: np.ndarray, length: int = LENGTH, max_docs: int = MAX_DOCUMENTS, max_cost: int = MAX_COST,
               weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must be in decreasing order."""
    if len(lengths) and (lengths[0] > length or int(lengths[0]) ** 2 > max_cost):
        raise ValueError("a piece is larger than a sequence")
    w0, w1, w2 = weights[0] / length**2, weights[1] / max_docs**2, weights[2] / max_cost**2
    # Residuals of the open sequences, one array a component; name is the sequence's number.
    tokens, docs, cost = (np.empty(len(lengths)) for _ in range(3))
    name = np.empty(len(lengths), np.int64)
    bins, offs = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    n_open = 0
    least = int(lengths[-1]) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        at = -1
        if n_open:
            t, d, c = tokens[:n_open] - n, docs[:n_open] - 1, cost[:n_open] - n * n
            score = w0 * t * t + w1 * d * d + w2 * c * c if rule == "norm" else -(w0 * n * tokens[:n_open] + w1 * docs[:n_open] + w2 * n * n * cost[:n_open])
            score[(t < 0) | (d < 0) | (c < 0)] = np.inf
            best = int(score.argmin())
            at = best if score[best] < np.inf else -1
        if at < 0:
            at = n_open
            tokens[at], docs[at], cost[at], name[at] = length, max_docs, max_cost, len(used)
            used.append(0)
            n_open += 1
        bins[i], offs[i] = name[at], used[name[at]]
        used[name[at]] += n
        tokens[at] -= n
        docs[at] -= 1
        cost[at] -= n * n
        if tokens[at] < least or docs[at] < 1 or cost[at] < least * least:  # no piece to come fits: closed
            n_open -= 1
            for x in (tokens, docs, cost, name):
                x[at] = x[n_open]
    return bins, offs


def pack(pieces: DataFrame, length: int = LENGTH, max_docs: int = MAX_DOCUMENTS, max_cost: int = MAX_COST,
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """pieces (doc_id, piece, length, ...) -> the same with sequence_id and offset (gapless from 0).

    ``pieces`` is read twice and should be a table. Equal lengths go by doc_id and piece.
    """
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    whole = pieces.filter(F.col("length") == length)
    short = pieces.filter(F.col("length") < length)
    if pieces.filter((F.col("length") > length) | (F.col("length") < 1) | F.col("length").isNull()).limit(1).count():
        raise ValueError("piece lengths must be from 1 to the sequence's length")
    n = short.count()
    groups = max(1, -(-n // group))
    keyed = short.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offs = pack_group(t["length"].to_numpy().astype(np.int64), length, max_docs, max_cost, weights, rule)
        g = t["_g"][0].as_py()
        # Odd numbers belong to groups; whole pieces take even ones.
        t = t.append_column("sequence_id", pa.array((bins * groups + g) * 2 + 1)).append_column("offset", pa.array(offs))
        return t.drop_columns(["_g"])

    schema = short.select(*carried).schema.add("sequence_id", "long").add("offset", "long")
    packed = keyed.select(*carried, "_g").groupBy("_g").applyInArrow(run, schema)
    # Whole pieces are numbered by the partition they are in and their place there.
    alone = whole.select(*carried).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def packed_documents(docs: DataFrame, vocabulary: str, name: str = "packing") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. The
    pieces without their ids are written to the shared folder, so texts are encoded once."""
    return pack(persist_table(pieces(docs, vocabulary, with_ids=False), name))
