"""Byte-level BPE by a global shuffle of distinct words.

Encoding: the pre-tokens of a block of documents are exploded with their positions; a
position is the number of its word among the block's distinct words. Per block and bucket
(a hash of the word) one row carries the distinct words to the bucket's task, where each
distinct word of the corpus is encoded once, and the ids go back to the block, whose
positions put them together again. What is shuffled is distinct words of blocks, so a word
in every document costs a row entry a block, and no text is shuffled.

Decoding: ids join the token-byte table (a fixed size, read from the vocabulary file by
each worker) by position in that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import give_back, id_text, in_parts
from strata.llm.tokens import from_ranks, rank_table

#: Bytes of text of one block, and buckets that the words of all blocks are dealt to.
BLOCK_BYTES = 8 << 20

# The white space of the pattern's engine, and the pattern for ASCII texts.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
_ascii = re.compile(ASCII_PATTERN)
_patterns: dict[str, regex.Pattern] = {}


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with its engine's white space spelled out, so that any engine splits alike."""
    if pattern not in _patterns:
        inner = "".join(map(chr, SPACES))
        space = f"[{inner}]"
        spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{inner}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"{space}+(?![^{inner}])").replace(r"|\s+", f"|{space}+")
        _patterns[pattern] = regex.compile(spelled)
    return _patterns[pattern]


def pre_tokens(text: str, pattern: str) -> list[str]:
    import public_tokenizers

    if pattern == public_tokenizers.PATTERN and text.isascii():
        return _ascii.findall(text)
    return splitter(pattern).findall(text)


class _Numbers(dict):
    """word -> number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack_ints(x: np.ndarray) -> bytes:
    """Small integers, compressed by byte planes."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _numbered(block: int, numbers: _Numbers, held: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Words and documents of a block, numbered by falling frequency: frequent words get small numbers."""
    words = list(numbers)
    count = np.zeros(len(words), np.int64)
    for _, x in held:
        count += np.bincount(x, minlength=len(words))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    return [words[i] for i in order], [(i, rank[x]) for i, x in held]


def _blocks(docs: DataFrame, pattern: str, buckets: int, block_bytes: int, want: str) -> DataFrame:
    """One scan of the texts in blocks of a bounded size. want='docs': (block, doc_id, data), the numbers
    of a document's words in order; want='words': (block, bucket, numbers, sizes, words), the block's
    distinct words of a bucket."""

    def doc_rows(block: int, words: list[str], docs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * len(docs), pa.int64()), pa.array([i for i, _ in docs], pa.int64()),
                                           pa.array([pack_ints(x) for _, x in docs], pa.binary())], names=["block", "doc_id", "data"])

    def word_rows(block: int, words: list[str], docs: list[tuple]) -> pa.RecordBatch | None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in raw), np.int64, len(raw))
        out = []
        for k in np.unique(of).tolist():
            mine = sorted(np.flatnonzero(of == k).tolist(), key=raw.__getitem__)
            out.append((block, k, pack_ints(np.array(mine)), pack_ints(np.array([len(raw[i]) for i in mine])), zstandard.compress(b"".join(raw[i] for i in mine), 3)))
        if not out:
            return None
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "bucket", "numbers", "sizes", "words"])

    make = doc_rows if want == "docs" else word_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block is named by its partition of the scan and its number there: both scans cut alike.
        block, size = TaskContext.get().partitionId() << 24, 0
        numbers, held = _Numbers(), []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                tokens = pre_tokens(t, pattern)
                held.append((i, np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))))
                size += len(t)
                if size >= block_bytes:
                    if (rows := make(block, *_numbered(block, numbers, held))) is not None:
                        yield rows
                    block, size, numbers, held = block + 1, 0, _Numbers(), []
        if held and (rows := make(block, *_numbered(block, numbers, held))) is not None:
            yield rows
        del numbers, held
        give_back()

    schema = "block long, doc_id long, data binary" if want == "docs" else "block long, bucket int, numbers binary, sizes binary, words binary"
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents (doc_id, text, ...) -> (doc_id, ids array<int>), a row per input row.

    Ids are those of the rank file with the pattern's pre-tokens each merged by itself and no
    special tokens. A null text is empty and has no ids.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = id_text(docs)
    words = _blocks(base, pattern, width, block_bytes, "words")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = from_ranks(ranks)
        known: dict[bytes, list[int]] = {}
        for b in (part for whole in batches for part in in_parts(whole)):
            for block, numbers, sizes, raw in zip(*(b.column(c).to_pylist() for c in ("block", "numbers", "sizes", "words"))):
                raw, ends, got, at = zstandard.decompress(raw), np.cumsum(unpack_ints(sizes)).tolist(), [], 0
                for end in ends:
                    w, at = raw[at:end], end
                    x = known.get(w)
                    if x is None:
                        x = known[w] = enc._encode_single_piece(w)
                    got.append(x)
                size = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter((i for x in got for i in x), np.int64, int(size.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([numbers], pa.binary()), pa.array([pack_ints(size)], pa.binary()),
                                                  pa.array([pack_ints(flat)], pa.binary())], names=["block", "numbers", "sizes", "ids"])
        del known
        give_back()

    coded = words.repartition(width, "bucket").mapInArrow(merge, "block long, numbers binary, sizes binary, ids binary")
    held = _blocks(base, pattern, width, block_bytes, "docs")

    def reassemble(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        joined = lambda c: np.concatenate([*map(unpack_ints, right[c].to_pylist()), np.empty(0, np.int64)])
        number, size, flat = joined("numbers"), joined("sizes"), joined("ids").astype(np.int32)
        begin, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        begin[number], length[number] = np.cumsum(size) - size, size
        out, ends = [np.empty(0, np.int32)], [0]
        for raw in left["data"].to_pylist():
            x = unpack_ints(raw)
            n = length[x]
            # Positions in flat: each word's run, one after the other.
            out.append(flat[np.repeat(begin[x] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
            ends.append(ends[-1] + len(out[-1]))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))
        del out, number, size, flat, begin, length
        give_back()
        return pa.table({"doc_id": left["doc_id"], "ids": ids})

    return held.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(reassemble, "doc_id long, ids array<int>")


_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def token_table(ranks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: (bytes, start of each id, length of each id)."""
    if ranks not in _tables:
        by_id = {i: t for t, i in rank_table(ranks).items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        size = np.array([len(t) for t in tokens], np.int64)
        _tables[ranks] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
    return _tables[ranks]


def decoded_bytes(ids: pa.Array, ranks: str) -> pa.Array:
    """The bytes of each row's ids, joined; the rows of a batch share one buffer, which the array takes as it is."""
    table, start, size = token_table(ranks)
    flat, off = np.asarray(ids.values), np.asarray(ids.offsets)
    out, ends = bytearray(), [0]
    for i, j in zip(off[:-1], off[1:]):
        x = flat[i:j]
        n = size[x]
        at = np.repeat(start[x] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out += table[at].data
        ends.append(len(out))
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(out)])


def decode(ids: DataFrame, ranks: str) -> DataFrame:
    """(.., ids array<int>) -> the same with ``decoded`` binary: the bytes of the ids, joined."""

    @F.arrow_udf("binary")
    def join(a: pa.Array) -> pa.Array:
        out = decoded_bytes(a, ranks)
        give_back()
        return out

    return ids.withColumn("decoded", join(F.col("ids")))


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256."""
    out = decode(encode(docs, ranks), ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
