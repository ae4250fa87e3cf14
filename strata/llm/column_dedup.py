"""Exact removal of repeated byte strings by column-wise construction over many segments.

A string of ``length`` bytes is removed where it also starts earlier (smaller id, or the
same document further left). Each of its starts is named by its minimizer: the k-byte
string of least hash inside it. Equal strings have equal minimizers at equal places in
them, so it suffices to compare the surroundings of equal minimizers, aligned at them.
Consecutive starts with one minimizer form a segment of at most 2 * length - k bytes.

1. One scan of the texts finds the segments (a hash per start from prefix sums, a sliding
   minimum) and emits (minimizer, hash of the whole segment, place). Segments that are equal
   within a task are settled there: all but the first are repeats from end to end, so a
   passage in a third of all documents leaves a task as one row.
2. Sorted by minimizer (Spark's external sort), equal whole segments are settled across
   tasks; where segments of one minimizer differ, at the borders of repeats, their bytes
   are fetched.
3. These segments are built into a collection column by column, from right to left: each
   round puts one symbol of every segment in front of its suffix, which sorts the collection
   anew by a stable counting sort (the symbols in the current order are the column of the
   transform) and updates the common prefixes of neighbours by range minima. In a column
   where strings start, neighbours with a common prefix of ``length`` are equal strings.
   Sorted runs of segments stream through a task in chunks of whole groups.

A plain construction over whole documents needs a round per byte of the longest document;
here the rounds are bounded by 2 * length - k. Step 3 compares bytes; step 2 relies on two
independent 64-bit hashes being equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType

from strata.llm.common import give_back, id_text
from strata.llm.shingles import mix64
from strata.session import persist_table

LENGTH, K = 100, 32
#: Bytes hashed at a time, bytes of text whose segments are settled together, segments built together.
SLICE, SETTLE, CHUNK = 1 << 20, 32 << 20, 60_000
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x)


class _Hasher:
    """Hashes of any substring of one array from prefix sums modulo 2^64."""

    up, down = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_Hasher.up) < n:
            _Hasher.up, _Hasher.down = _powers(_B, n), _powers(_B_INV, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.up[: n - 1], out=self.sums[1:])

    def at(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[: len(self.sums)][start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i with a whole window."""
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(data: np.ndarray, piece_end: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of concatenated pieces: (minimizer hash, segment hash, q, p1, p2) arrays, where the
    string starts p1..p2 have their minimizer at q. piece_end: where each piece ends, in order."""
    empty = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return empty
    hasher = _Hasher(data)
    n = len(data) - k + 1
    grams = hasher.at(slice(0, n), slice(k, k + n))
    mask = _U((1 << 24) - 1)
    low = _sliding_min((grams & ~mask) | np.arange(n, dtype=np.uint64), length - k + 1)
    q = (low & mask).astype(np.int64)
    piece = np.searchsorted(piece_end, np.arange(len(q)), side="right")
    ok = np.arange(len(q)) + length <= piece_end[piece]
    p = np.flatnonzero(ok)
    if not len(p):
        return empty
    key = q[p]
    new = np.empty(len(p), bool)
    new[0] = True
    new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    p1, p2 = p[first], p[np.append(first[1:], len(p)) - 1]
    q = key[first]
    whole = mix64(hasher.at(p1, p2 + length) ^ mix64(((q - p1) * 1024 + (p2 - p1)).astype(np.uint64)))
    return grams[q], whole, q, p1, p2


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of spans per document, overlapping and touching ones joined; sorted."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    # A running maximum of ends that starts anew with each document.
    rank = np.cumsum(np.append(True, doc[1:] != doc[:-1])).astype(np.int64)
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * big) - rank * big
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


_FOUND = "key long, whole long, doc long, q long, p1 int, p2 int"
_NAMES = ["key", "whole", "doc", "q", "p1", "p2"]


def _batch(*cols: np.ndarray) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip(cols, kinds)], names=_NAMES)


def _find(length: int, k: int):
    """Rows of segments (p1, p2: starts before and after q), and settled spans as rows with p1 = -1:
    (doc hash, 0, doc, start, -1, size)."""

    def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, whole, doc, q, p1, p2 = (np.concatenate(c) for c in zip(*parts))
        o = np.lexsort((p1, doc, whole, key))
        key, whole, doc, q, p1, p2 = (c[o] for c in (key, whole, doc, q, p1, p2))
        same = np.append(False, (key[1:] == key[:-1]) & (whole[1:] == whole[:-1]))
        first = np.flatnonzero(~same)
        lead = np.repeat(first, np.diff(np.append(first, len(key))))
        again = same & ((doc != doc[lead]) | (p1 != p1[lead]))
        yield _batch(*(c[~same] for c in (key, whole, doc, q)), (q - p1)[~same], (p2 - p1)[~same])
        d, s, e = merge_spans(doc[again], p1[again], p2[again] + length)
        for i in range(0, len(d), 1 << 18):
            j = slice(i, i + (1 << 18))
            yield _batch(mix64(d[j].astype(np.uint64)), np.zeros(len(d[j]), np.int64), d[j], s[j], np.full(len(d[j]), -1), e[j] - s[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held: list[tuple[int, int, bytes]] = []
        size = seen = 0

        def hash_held() -> None:
            nonlocal size
            data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
            ends = np.cumsum([len(x) for _, _, x in held])
            key, whole, q, p1, p2 = segments(data, ends, length, k)
            piece = np.searchsorted(ends, p1, side="right")
            base = np.array([at for _, at, _ in held], np.int64)[piece] - (np.append(0, ends[:-1]))[piece] if len(piece) else np.empty(0, np.int64)
            doc = np.array([i for i, _, _ in held], np.int64)[piece] if len(piece) else np.empty(0, np.int64)
            parts.append((key, whole, doc, q + base, p1 + base, p2 + base))
            held.clear()
            size = 0

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                raw = t.encode("utf-8", "surrogatepass") if t and i is not None else b""
                # A long text goes in slices that share length - 1 bytes, so each start is in one.
                for at in range(0, max(len(raw) - length + 1, 0), SLICE):
                    piece = raw[at : at + SLICE + length - 1]
                    held.append((i, at, piece))
                    size += len(piece)
                    seen += len(piece)
                    if size >= SLICE:
                        hash_held()
                if seen >= SETTLE:
                    if held:
                        hash_held()
                    yield from settle(parts)
                    parts, seen = [], 0
        if held:
            hash_held()
        yield from settle(parts)

    return run


def _settle_sorted(length: int):
    """Rows sorted by (key, whole, doc, q): settled spans as they are; equal segments settled across
    tasks; the firsts of differing segments of one minimizer passed on (p1 >= 0)."""

    def done(c: list[np.ndarray]) -> pa.RecordBatch:
        key, whole, doc, q, p1, p2 = c
        span = p1 < 0
        k, w, d, at, a, n = (x[~span] for x in c)
        if len(k):
            same_key = np.append(False, k[1:] == k[:-1])
            same = same_key & np.append(False, w[1:] == w[:-1])
            first = np.flatnonzero(~same)
            lead = np.repeat(first, np.diff(np.append(first, len(k))))
            again = same & ((d != d[lead]) | (at != at[lead]))
            group = np.cumsum(~same_key) - 1
            kinds = np.bincount(group, weights=~same)
            open_ = ~same & (kinds[group] > 1)
            start = at - a
            spans = (k[again], w[again], d[again], start[again], np.full(int(again.sum()), -1), n[again] + length)
            out = [np.concatenate([x[span], y, z]) for x, y, z in zip(c, spans, (k[open_], w[open_], d[open_], at[open_], a[open_], n[open_]))]
        else:
            out = c
        return _batch(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            new = [np.asarray(b.column(i)) for i in range(6)]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            # The last minimizer may go on in the next batch.
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if cut:
                yield done([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield done(held)

    return run


def repeats(columns: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """columns (segments x width, aligned, in document order; 0 outside a segment); strings of
    ``length`` start in columns first..last of each segment. -> bool (segments x starts): an equal
    string starts in the same column of an earlier segment."""
    n, width = columns.shape
    order, lcp = np.arange(n), np.zeros(n, np.int32)
    out = np.zeros((n, width - length + 1), bool)
    for c in range(width - 1, -1, -1):
        symbol = columns[order, c]
        to = np.argsort(symbol, kind="stable")
        sorted_ = symbol[to]
        joined = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
        new = np.zeros(n, np.int32)
        if len(joined):
            # Neighbours that keep company share one symbol more than all that lay between them.
            bounds = np.empty(2 * len(joined), np.int64)
            bounds[0::2], bounds[1::2] = to[joined - 1] + 1, to[joined] + 1
            padded = np.append(lcp, np.int32(0))
            new[joined] = np.minimum.reduceat(padded, bounds)[0::2] + 1
        order, lcp = order[to], new
        if c < out.shape[1]:
            valid = (first[order] <= c) & (c <= last[order])
            if valid.any():
                at = np.flatnonzero(lcp < length)
                at = at if at[0] == 0 else np.append(0, at)
                low = np.minimum.reduceat(np.where(valid, order, n), at)
                low = np.repeat(low, np.diff(np.append(at, n)))
                out[order[valid & (order > low)], c] = True
    return out


def _build(length: int, k: int):
    """Rows (key, doc, q, p1, p2, bytes) with equal keys together -> spans (doc, start, end)."""
    left, width = length - k, 2 * length - k

    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        doc, q, p1, p2 = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
        o = np.lexsort((q, doc))
        doc, q, p1, p2 = doc[o], q[o], p1[o].astype(np.int64), p2[o].astype(np.int64)
        raw = [t.column(5)[int(i)].as_py() for i in o] if len(o) < 64 else np.array(t.column(5).to_pylist(), dtype=object)[o].tolist()
        size = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        cols = np.zeros((len(raw), width), np.uint8)
        row = np.repeat(np.arange(len(raw)), size)
        cols[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left - p1, size)] = flat
        # The same place twice (a repeated row) is one segment.
        one = np.append(True, (doc[1:] != doc[:-1]) | (q[1:] != q[:-1]) | (p1[1:] != p1[:-1]))
        doc, q, p1, p2, cols = doc[one], q[one], p1[one], p2[one], cols[one]
        hit = repeats(cols, left - p1, left - p1 + p2, length)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        # Column c of a start is place q - left + c.
        d, s, e = merge_spans(doc[r], q[r] - left + a, q[r] - left + b - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                keys = np.asarray(b.column(0))
                cut = int(np.searchsorted(keys, keys[-1], side="left"))
                if cut:
                    held[-1] = b.slice(0, cut)
                    yield spans(held)
                    held, n = [b.slice(cut)], b.num_rows - cut
        if n:
            yield spans(held)

    return run


def _fetch(length: int):
    """(text, list of segments) -> a row per segment with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, segs in zip(*(b.column(j) for j in range(3))):
                i, t, segs = i.as_py(), t.as_py(), segs.as_py()
                raw = t.encode("utf-8", "surrogatepass")
                cut = [raw[s["q"] - s["p1"] : s["q"] - s["p1"] + s["p2"] + length] for s in segs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["key"] for s in segs], pa.int64()), pa.array([i] * len(segs), pa.int64()), pa.array([s["q"] for s in segs], pa.int64()),
                     pa.array([s["p1"] for s in segs], pa.int32()), pa.array([s["p2"] for s in segs], pa.int32()), pa.array(cut, pa.binary())],
                    names=["key", "doc", "q", "p1", "p2", "bytes"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, name: str = "column-dedup") -> DataFrame:
    """documents (doc_id, text) -> (doc_id, spans array<struct<start,end>>): byte spans to remove,
    maximal and sorted, for each document that has some."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = id_text(docs)
    found = base.mapInArrow(_find(length, k), _FOUND).repartition(width, "key").sortWithinPartitions("key", "whole", "doc", "q")
    settled = persist_table(found.mapInArrow(_settle_sorted(length), _FOUND), f"{name}-settled")
    open_ = settled.filter("p1 >= 0").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "q", "p1", "p2")).alias("segs"))
    texts = base.join(open_, "doc_id").select("doc_id", "text", "segs")
    bytes_ = texts.mapInArrow(_fetch(length), "key long, doc long, q long, p1 int, p2 int, bytes binary")
    built = (bytes_.repartition(width, "key").sortWithinPartitions("key")
             .mapInArrow(_build(length, k), "doc long, start long, end long"))
    whole = settled.filter("p1 < 0").select("doc", F.col("q").alias("start"), (F.col("q") + F.col("p2")).alias("end"))
    spans = whole.union(built).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "end")).alias("s"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            o, s, e = merge_spans(owner, np.asarray(flat.field(0)), np.asarray(flat.field(1)))
            ends = np.searchsorted(o, np.arange(len(lists) + 1))
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "spans"])

    return persist_table(spans.mapInArrow(join, "doc_id long, spans array<struct<start:long,end:long>>"), f"{name}-spans")


@F.arrow_udf(BinaryType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(texts, spans):
        t, s = t.as_py(), s.as_py()
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if s:
            at, parts = 0, []
            for x in s:
                parts.append(raw[at : x["start"]])
                at = x["end"]
            raw = b"".join([*parts, raw[at:]])
        out.append(raw)
    return pa.array(out, pa.binary())


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, name: str = "column-dedup") -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_bytes, spans, kept (binary); a row per input row.

    A null text is empty. A repeated row starts nowhere earlier than its twin, so both keep the
    same bytes. A row without an id takes no part and keeps its text.
    """
    spans = repeated_spans(docs, length, k, name)
    return (id_text(docs).join(spans, "doc_id", "left")
            .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), _cut("text", "spans").alias("kept")))


def digests(docs: DataFrame, name: str = "column-dedup") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs, name=name)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, name: str = "column-dedup-stage") -> DataFrame:
    """documents with the repeats taken out of ``text`` (characters that a cut splits go too) and
    ``n_chars``, where there is one, counted anew; other columns and all rows stay."""
    spans = repeated_spans(docs, name=name).select(F.col("doc_id").alias("_id"), "spans")
    # Columns go by place, so that no name clashes and a text is held once beside the Python stage.
    names, place = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    of = dict(zip(names, place))
    row = docs.toDF(*place).withColumn("_id", F.col(of["doc_id"]).cast("long")).join(spans, "_id", "left")
    own = F.col(of["text"]).cast("string")
    row = row.withColumn("_text", F.when(F.col("spans").isNull(), own).otherwise(_cut_text(own, "spans")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return row.select(*[new.get(n, F.col(p)).alias(n) for n, p in zip(names, place)])


@F.arrow_udf(StringType())
def _cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What the spans (of bytes) leave of each text; a text without any, which is not asked for, is null."""
    out = []
    for t, s in zip(texts, spans):
        t, s = t.as_py() if s.is_valid else None, s.as_py()
        if t is not None:
            raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for x in s:
                parts.append(raw[at : x["start"]])
                at = x["end"]
            t = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
        out.append(t)
    done = pa.array(out, pa.string())
    del out
    give_back()
    return done
