"""Token ids in files compressed by Re-Pair grammars.

Documents are dealt by ranges of their ids, so that partitions follow each other in doc_id order.
A task encodes its documents in that order and writes files of some FILE_IDS ids; their ids are cut
into shards of at most SHARD ids, each with a grammar of its own. A round counts the pairs of
neighbouring symbols of a shard and replaces the frequent ones by new symbols, the more frequent
of two overlapping pairs first; rounds go on while they shorten the shard by a set share.

A file holds the documents' ids and lengths and, per shard, the rules, their expansion
lengths, and blocks of symbols with the number of ids before each block, so the ids
at any place are read with the rules and the blocks that hold them, the rest staying unread.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strata.llm.common import id_text, in_parts, parts_for
from strata.llm.tokens import CLOSE_ID, encode_json
from strata.llm.zip_warc import open_fs
from strata.session import persist_table, scratch_path

#: Ids of a file and of a shard (of one grammar), about; symbols of a block.
FILE_IDS, SHARD, BLOCK = 4 << 20, 1 << 18, 1 << 14
#: A pair is replaced where it occurs so often; a round must shorten the shard by this share to be followed by another.
MIN_PAIRS, GAIN = 4, 0.05
#: Slots in which pairs are counted.
SLOT_BITS = 17

MAGIC = b"RPIDS001"
HEAD = struct.Struct("<8sQQI")  # magic, documents, ids, shards
SHARD_HEAD = struct.Struct("<QQIIIIQQ")  # ids, symbols, first rule, rules, rounds, blocks, bytes of the tables, bytes of the blocks


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; the first byte is the number of planes."""
    x = np.ascontiguousarray(x).astype("<u8" if x.dtype.itemsize == 8 else "<u4")
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T
    used = max(1, next((k for k in range(len(planes), 0, -1) if planes[k - 1].any()), 1))
    return bytes([used]) + zstandard.compress(planes[:used].tobytes(), 1)


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    used, flat = raw[0], np.frombuffer(zstandard.decompress(raw[1:]), np.uint8)
    n = len(flat) // used
    wide = np.zeros((n, 8 if used > 4 else 4), np.uint8)
    wide[:, :used] = flat.reshape(used, n).T
    return wide.view("<u8" if used > 4 else "<u4").ravel().astype(kind)


def re_pair(ids: np.ndarray, first_rule: int, min_pairs: int = MIN_PAIRS, gain: float = GAIN) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(symbols, rounds of rules): a round's rules (left, right) are numbered on from the one before
    and use symbols of earlier rounds only."""
    seq = np.ascontiguousarray(ids, np.int32)
    bits = min(SLOT_BITS, max(8, int(len(seq)).bit_length()))
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    rule = first_rule
    ties = (np.arange(1 << bits) * 0x9E3779B1 >> 7) & 0x7FF
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        mixed = a.view(np.uint32) * np.uint32(0x9E3779B1)
        mixed ^= b.view(np.uint32) * np.uint32(0x85EBCA77)
        mixed >>= np.uint32(32 - bits)
        slot = mixed.astype(np.intp)
        count = np.bincount(slot, minlength=1 << bits)
        # Of overlapping pairs the more frequent goes first, then one by its slot (alike in every copy
        # of a passage), and of a pair with itself (x x x) every second place.
        order = np.zeros(len(slot) + 2, np.int32)
        order[1:-1] = ((np.minimum(count, 0x3FFFF) << 12 | ties << 1).astype(np.int32))[slot]
        order[1:-1:2] |= 1
        first = order[1:-1] > order[:-2]
        first &= order[1:-1] > order[2:]
        first &= order[1:-1] >= min_pairs << 12
        at = np.flatnonzero(first)
        s, x, y = slot[at], a[at], b[at]
        # A slot stands for one pair (its last here); its other pairs wait for the next round.
        left, right = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        left[s], right[s] = x, y
        mine = (left[s] == x) & (right[s] == y)
        enough = np.bincount(s[mine], minlength=1 << bits) >= min_pairs
        mine &= enough[s]
        at, s = at[mine], s[mine]
        if not len(at):
            break
        used = np.flatnonzero(enough)
        name = np.zeros(1 << bits, np.int32)
        name[used] = rule + np.arange(len(used), dtype=np.int32)
        rounds.append((left[used], right[used]))
        rule += len(used)
        out = seq.copy()
        out[at] = name[s]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        done = len(at) < gain * len(seq)
        seq = out[stay]
        if done:
            break
    return seq, rounds


class Grammar:
    """Rules with the ids that each symbol stands for."""

    def __init__(self, rounds: list[tuple[np.ndarray, np.ndarray]], first_rule: int):
        # Symbol -> its run in ``flat``; plain ids stand for themselves.
        self.first, self.flat = first_rule, np.arange(first_rule, dtype=np.int32)
        self.start, self.size = np.arange(first_rule, dtype=np.int64), np.ones(first_rule, np.int64)
        for left, right in rounds:
            both = np.stack([left, right], 1).ravel()
            run = self.expand(both)
            size = self.size[left] + self.size[right]
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, run])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        ends = np.cumsum(n)
        at = np.repeat(self.start[symbols] - (ends - n), n)
        at += np.arange(len(at))
        return self.flat[at]


def shard_bytes(ids: np.ndarray) -> bytes:
    """One shard: its head, tables (rules by round, expansion lengths, blocks) and blocks."""
    first_rule = int(ids.max(initial=0)) + 1
    seq, rounds = re_pair(ids, first_rule)
    size = Grammar(rounds, first_rule).size
    sizes = size[seq]
    before = np.cumsum(sizes) - sizes
    blocks = [pack(seq[k : k + BLOCK]) for k in range(0, len(seq), BLOCK)]
    tables = [np.array([len(x) for x, _ in rounds], np.int64), np.concatenate([np.empty(0, np.int32), *(x for x, _ in rounds)]),
              np.concatenate([np.empty(0, np.int32), *(y for _, y in rounds)]), size[first_rule:], before[::BLOCK], np.array([len(x) for x in blocks], np.int64)]
    packed = [pack(t) for t in tables]
    body = b"".join(struct.pack("<Q", len(p)) + p for p in packed)
    return SHARD_HEAD.pack(len(ids), len(seq), first_rule, len(size) - first_rule, len(rounds), len(blocks), len(body), sum(map(len, blocks))) + body + b"".join(blocks)


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, shard: int = SHARD) -> list[bytes]:
    """The chunks of a file: head, documents (null marks, ids, lengths), shards."""
    cuts = max(1, -(-len(ids) // shard))
    edges = [len(ids) * k // cuts for k in range(cuts + 1)]
    named = np.array([0 if i is None else i for i in doc_ids], np.int64)
    docs = [pack(np.array([i is None for i in doc_ids], np.uint32)), pack(named.view(np.uint64)), pack(np.array(lengths, np.int64))]
    out = [HEAD.pack(MAGIC, len(doc_ids), len(ids), cuts), *(struct.pack("<Q", len(d)) + d for d in docs)]
    return out + [shard_bytes(ids[s:e]) for s, e in zip(edges, edges[1:])]


class IdFile:
    """Reads a file by ranges: the documents, whole shards, or the ids of one place."""

    def __init__(self, f):
        self.f = f
        magic, self.n_docs, self.n_ids, cuts = HEAD.unpack(f.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEAD.size
        parts = []
        for _ in range(3):
            (n,) = struct.unpack("<Q", f.read_at(8, at))
            parts.append(f.read_at(n, at + 8))
            at += 8 + n
        nulls, named = unpack(parts[0]), unpack(parts[1], np.uint64).view(np.int64)
        self.doc_ids = [None if z else int(i) for z, i in zip(nulls, named)]
        self.lengths = unpack(parts[2])
        self.shards = []  # (first id, head, where its tables begin)
        first = 0
        for _ in range(cuts):
            head = SHARD_HEAD.unpack(f.read_at(SHARD_HEAD.size, at))
            self.shards.append((first, head, at + SHARD_HEAD.size))
            first += head[0]
            at += SHARD_HEAD.size + head[6] + head[7]
        self._tables: dict[int, tuple] = {}

    def tables(self, k: int) -> tuple[Grammar, np.ndarray, np.ndarray, int]:
        """Grammar, ids before each block, where each block begins, and where the last one ends."""
        if k not in self._tables:
            _, (_, _, first_rule, rules, _, _, n_body, _), at = self.shards[k]
            body, parts, p = self.f.read_at(n_body, at), [], 0
            while p < n_body:
                (n,) = struct.unpack_from("<Q", body, p)
                parts.append(unpack(body[p + 8 : p + 8 + n]))
                p += 8 + n
            per_round, left, right, sizes, before, lengths = parts
            cuts = np.cumsum(per_round)[:-1] if len(per_round) else []
            grammar = Grammar(list(zip(np.split(left, cuts), np.split(right, cuts))) if rules else [], first_rule)
            if not np.array_equal(grammar.size[first_rule:], sizes):
                raise ValueError("rules do not match their expansion lengths")
            starts = at + n_body + np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            self._tables = {k: (grammar, before, starts)}  # one shard's tables at a time
        return self._tables[k]

    def shard_ids(self, k: int) -> np.ndarray:
        grammar, _, starts = self.tables(k)
        if len(starts) < 2:
            return np.empty(0, np.int32)
        raw, base = self.f.read_at(int(starts[-1] - starts[0]), int(starts[0])), starts[0]
        return grammar.expand(np.concatenate([unpack(raw[s - base : e - base]) for s, e in zip(starts, starts[1:])]))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to before ``end`` of the file, from the blocks that hold them."""
        out = [np.empty(0, np.int32)]
        for k, (first, head, _) in enumerate(self.shards):
            lo, hi = max(begin - first, 0), min(end - first, head[0])
            if lo >= hi:
                continue
            grammar, before, starts = self.tables(k)
            b = int(np.searchsorted(before, lo, "right")) - 1
            e = int(np.searchsorted(before, hi, "left"))
            symbols = np.concatenate([unpack(self.f.read_at(int(starts[j + 1] - starts[j]), int(starts[j]))) for j in range(b, e)])
            ends = int(before[b]) + np.cumsum(grammar.size[symbols])
            x, y = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
            skip = lo - int(ends[x] - grammar.size[symbols[x]])
            out.append(grammar.expand(symbols[x:y])[skip : skip + hi - lo])
        return np.concatenate(out)


MANIFEST = "part int, number int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, vocabulary: str, folder: str, file_ids: int = FILE_IDS, shard: int = SHARD) -> DataFrame:
    """documents -> files of ids in ``folder`` and their manifest (part, number, path, n_docs, n_ids),
    a table; (part, number) is the files' order by doc_id, nulls first.

    A null text has the closing id alone. Rows of one doc_id follow each other by their text's hash.
    A file has a name of its own attempt, so only files of tasks that ended are in the manifest.
    """
    ordered = id_text(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/{part:08d}-{number:08d}-{uuid.uuid4().hex[:8]}.ids"
            with fs.open_output_stream(name) as out:
                for chunk in file_bytes(names, [len(x) for x in held], np.concatenate(held), shard):
                    out.write(chunk)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [name],
                                               "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([size], pa.int64())})

        for batch in batches:
            for b in in_parts(batch):
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    names.append(i)
                    held.append(np.append(encode_json(vocabulary, t.as_py() or ""), np.uint32(CLOSE_ID)))
                    size += len(held[-1])
                    if size >= file_ids:
                        yield flush()
                        names, held, size, number = [], [], 0, number + 1
        if names:
            yield flush()

    return persist_table(ordered.mapInArrow(run, MANIFEST), "id-manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    # Ids before each file: sums within a partition, after those of the partitions before it (one row each).
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    placed = manifest.withColumn("inside", inside).join(before, "part").select("path", (F.col("first") + F.col("inside")).alias("first"))
    n = parts_for(manifest, manifest.count(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    file = IdFile(f)
                    ends = np.cumsum(file.lengths)
                    crcs = [0] * file.n_docs
                    at = doc = 0
                    for k in range(len(file.shards)):
                        ids = file.shard_ids(k).astype("<u4")
                        done = 0
                        # A document may go on from one shard to the next.
                        while doc < file.n_docs and done < len(ids):
                            take = min(int(ends[doc]) - at, len(ids) - done)
                            crcs[doc] = zlib.crc32(ids[done : done + take], crcs[doc])
                            at, done = at + take, done + take
                            doc += at == ends[doc]
                    if doc != file.n_docs or at != file.n_ids:
                        raise ValueError(f"{path} holds {at} ids, not {file.n_ids}")
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(first + ends - file.lengths, pa.int64()),
                                                      pa.array(file.lengths, pa.int64()), pa.array(crcs, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the documents' ids and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_documents(write_ids(docs, vocabulary, folder), folder)
