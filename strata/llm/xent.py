"""Cross-entropy difference of two matched bigram models.

The target and the background model share one vocabulary, one list of bigrams, order and
smoothing; only their counts differ. A document's score is the mean over its tokens of
target loss minus background loss: the lower, the more it reads like the target.

Every word and every bigram of the texts enters the model, which therefore grows with the
input and is never held in one process. Texts are read once, into blocks: the numbers of
their words among the block's distinct words, and the words' 63-bit hashes. A block deals its
distinct bigrams with their counts to buckets by context, a frequent context by context and
word, a packed row per block and bucket. A bucket's task adds the counts of all blocks and
returns each block the totals of its own bigrams in the order they were sent; its contexts' sums go the
same way, with the words' counts, through buckets of words. A block then has all that the
losses of its documents need, so neither a text nor a loss is shuffled for each bigram.
Discounted mass of a context goes to the unigrams, so each context's probabilities add up to one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import give_back, id_text, in_parts
from strata.session import persist_table

#: Least share of the tokens of either corpus for a word or bigram to enter; 0: all of them do.
WORD_SHARE, BIGRAM_SHARE = 0.0, 0.0
DISCOUNT, ADD = 0.75, 0.5
#: Tokens counted together, and tokens of the texts for each bucket of bigrams and of words.
BLOCK = 1_000_000
PER_BUCKET, PER_WORDS = 1_000_000, 8_000_000
#: Accepted for callers that set it; no losses are broadcast any more.
HEAD = 1_000_000
#: Keys of a document's start and of any word outside the vocabulary; hashes of words are not negative.
START, OTHER = -1, -2
#: Contexts with more than 1/HOT of the tokens are dealt in parts of at most about 1/SPLIT of a bucket.
HOT, SPLIT = 4096, 4
#: What a word's totals hold: its own counts in the target and in all texts; as a context, the counts of its
#: bigrams, those of its kept bigrams, and the number of its kept bigrams.
FIELDS = ("ut", "ub", "nt", "nb", "kt", "kb", "dt", "db")
BLOCKS = "block long, doc_id array<long>, n long, t long, sizes binary, target binary, tokens binary, hashes binary, hot array<long>, hot_n array<long>"
ROWS = "block long, kind int, bucket int, data array<binary>"
BIGRAMS, WORDS, VOCABULARY = 0, 1, 2


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pack(x: np.ndarray) -> bytes:
    """Integers, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Ids(dict):
    """Numbers of a block's words, in order of appearance."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


class Texts:
    """The documents of a block while they are read; word 0 is a document's start."""

    def __init__(self) -> None:
        self.ids = _Ids({None: 0})
        self.tokens: list[np.ndarray] = []
        self.doc_id: list[int | None] = []
        self.target: list[bool] = []
        self.n = 0

    def add(self, doc_id: int | None, target: bool, text: str | None) -> None:
        found = words(text)
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
        self.doc_id.append(doc_id)
        self.target.append(target)
        self.n += len(found)

    def row(self, block: int) -> tuple:
        size = np.array([len(t) for t in self.tokens], np.int64)
        tokens = np.concatenate([np.empty(0, np.int32), *self.tokens])
        of = b"".join(blake2b(w, digest_size=8).digest() for w in self.ids if w is not None)
        return block_row(block, self.doc_id, size, np.array(self.target, np.int64), tokens, np.append(START, (np.frombuffer(of, np.uint64) >> 1).astype(np.int64)))


def block_row(block: int, doc_id: list, size: np.ndarray, target: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> tuple:
    """A block as a row of BLOCKS. Frequent words get small numbers; words of one hash become one. The words
    that are contexts of 1/(2 HOT) of the block's tokens come with their counts."""
    hashes, same = np.unique(hashes, return_inverse=True)
    tokens = same[tokens]
    count = np.bincount(tokens, minlength=len(hashes))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tokens, hashes = rank[tokens], hashes[order]
    b = Block(size, target, tokens, hashes)
    context = np.bincount(b.context, minlength=len(b.hashes))
    hot = np.flatnonzero(context * 2 * HOT >= max(len(tokens), 1))
    return (block, doc_id, len(tokens), int(size @ target), pack(size), pack(target), pack(tokens), pack(hashes), b.hashes[hot].tolist(), context[hot].tolist())


class Block:
    """Documents as numbers of words, which are in the order of their hashes here."""

    def __init__(self, size: np.ndarray, target: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.size, self.target, self.hashes = size, target, hashes[order]
        self.word = rank[tokens]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[(np.cumsum(size) - size)[size > 0]] = np.searchsorted(self.hashes, START)

    @classmethod
    def of(cls, sizes: bytes, target: bytes, tokens: bytes, hashes: bytes) -> Block:
        return cls(*map(unpack, (sizes, target, tokens, hashes)))

    def of_token(self, x: np.ndarray) -> np.ndarray:
        """A value per document, for each token."""
        return np.repeat(x, self.size)

    def bigrams(self, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, bucket) of the distinct bigrams, by bucket, context and word; the bigram of each token;
        and the bigrams' number of tokens."""
        keys, at, n = np.unique(self.context * len(self.hashes) + self.word, return_inverse=True, return_counts=True)
        c, w = keys // len(self.hashes), keys % len(self.hashes)
        parts, (found, split) = np.ones(len(self.hashes), np.int64), hot
        _, here, there = np.intersect1d(self.hashes, found, assume_unique=True, return_indices=True)
        parts[here] = split[there]
        part = self.hashes[w] % parts[c]
        bucket = (_mix(self.hashes[c] + part * 0x5851F42D4C957F2D) >> np.uint64(20)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return c[order], w[order], bucket[order], place[at], n[order]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _kinds[c.split()[1]]) for c in schema.split(", ")])


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def read_blocks(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, target, text) -> BLOCKS, written once: whatever follows reads the same cut."""
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, Texts()
        for batch in batches:
            for b in in_parts(batch):
                for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    held.add(i, y, t.as_py())
                    if held.n >= BLOCK:
                        yield _batch([held.row(block)], schema)
                        block, held = block + 1, Texts()
        if held.doc_id:
            yield _batch([held.row(block)], schema)
        give_back()

    return persist_table(docs.select("doc_id", "target", "text").mapInArrow(run, BLOCKS), f"{name}-blocks")


def _each(blocks: DataFrame, columns: tuple[str, ...], fn, schema: str) -> DataFrame:
    """fn(column values of a block) -> rows of the schema."""
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from in_parts(_batch(list(fn(*(c[i].as_py() for c in b.columns))), kinds))
        give_back()

    return blocks.select(*columns).mapInArrow(run, schema)


_BLOB = ("sizes", "target", "tokens", "hashes")


def bigram_rows(blocks: DataFrame, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """ROWS of each block and bucket with the block's distinct bigrams: contexts, their numbers of words, the
    row's words, the place of each bigram's word among them, counts in the target and in all texts."""

    def rows(block: int, *blobs: bytes) -> Iterator[tuple]:
        b = Block.of(*blobs)
        c, w, bucket, at, n = b.bigrams(hot, buckets)
        t = np.bincount(at, weights=b.of_token(b.target), minlength=len(c)).astype(np.int64)
        cuts = _cuts(bucket)
        for i, j in zip(cuts[:-1], cuts[1:]):
            first = _cuts(c[i:j])
            word, of = np.unique(w[i:j], return_inverse=True)
            yield block, BIGRAMS, int(bucket[i]), [pack_sorted(b.hashes[c[i:j][first[:-1]]]), pack(np.diff(first)), pack_sorted(b.hashes[word]), pack(of), pack(t[i:j]), pack(n[i:j])]

    return _each(blocks, ("block", *_BLOB), rows, ROWS)


def _word_rows(block: int | None, hashes: np.ndarray, values: Iterable[np.ndarray | None], buckets: int) -> Iterator[tuple]:
    """ROWS of sorted words with some of the FIELDS, by bucket of words."""
    bucket = (_mix(hashes) >> np.uint64(20)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = _cuts(bucket[order])
    for i, j in zip(cuts[:-1], cuts[1:]):
        mine = order[i:j]
        yield block, WORDS, int(bucket[mine[0]]), [pack_sorted(hashes[mine]), *(b"" if x is None else pack(x[mine]) for x in values)]


def word_rows(blocks: DataFrame, buckets: int) -> DataFrame:
    """ROWS of each block and bucket with the block's distinct words and their own counts."""

    def rows(block: int, *blobs: bytes) -> Iterator[tuple]:
        b = Block.of(*blobs)
        count = lambda y: np.bincount(b.word, weights=y, minlength=len(b.hashes)).astype(np.int64)
        return _word_rows(block, b.hashes, (count(b.of_token(b.target)), count(None), *[None] * 6), buckets)

    return _each(blocks, ("block", *_BLOB), rows, ROWS)


def _kept(t: np.ndarray, b: np.ndarray, share: float, total: list[int]) -> np.ndarray:
    return (t >= max(share * total[0], 1.0)) | (b >= max(share * total[1], 1.0))


def bigram_totals(rows: DataFrame, share: float, total: list[int], word_buckets: int) -> DataFrame:
    """Bigram rows -> ROWS for the same blocks with the totals of their bigrams, and word rows of no block
    with the sums of the bucket's contexts."""
    schema = _arrow(ROWS)

    def add(group: pa.Table) -> pa.Table:
        sent = group.select(["block", "bucket", "data"]).to_pylist()
        data = [r["data"] for r in sent]
        joined = lambda x: np.concatenate([*x, np.empty(0, np.int64)])
        cs, ns, ws = [unpack_sorted(d[0]) for d in data], [unpack(d[1]) for d in data], [unpack_sorted(d[2]) for d in data]
        contexts, c = np.unique(joined(cs), return_inverse=True)
        c = np.repeat(c, joined(ns))
        vocabulary, w = np.unique(joined(ws), return_inverse=True)
        base = np.cumsum([0, *map(len, ws)])
        w = w[joined([unpack(d[3]) + k for d, k in zip(data, base)])]
        keys, at = np.unique(c * len(vocabulary) + w, return_inverse=True)
        del c, w
        t, b = (np.bincount(at, weights=joined([unpack(d[i]) for d in data]), minlength=len(keys)).astype(np.int64) for i in (4, 5))
        context = keys // max(len(vocabulary), 1)
        kept = _kept(t, b, share, total)
        sums = [np.bincount(context, weights=x, minlength=len(contexts)).astype(np.int64)
                for x in (t, b, t * kept, b * kept, kept & (t > 0), kept & (b > 0))]
        ends = np.cumsum([0, *(int(n.sum()) for n in ns)])
        out = [(r["block"], BIGRAMS, r["bucket"], [pack(t[at[i:j]]), pack(b[at[i:j]])]) for r, i, j in zip(sent, ends[:-1], ends[1:])]
        out += _word_rows(None, contexts, (None, None, *sums), word_buckets)
        del keys, at, t, b, context
        give_back()
        return pa.Table.from_batches([_batch(out, schema)])

    return rows.groupBy("bucket").applyInArrow(add, ROWS)


def word_totals(rows: DataFrame) -> DataFrame:
    """Word rows -> ROWS for the same blocks with the totals of their words, and a row of no block with the
    size of the bucket's vocabulary."""
    schema = _arrow(ROWS)

    def add(group: pa.Table) -> pa.Table:
        sent = group.select(["block", "bucket", "data"]).to_pylist()
        hashes = [unpack_sorted(r["data"][0]) for r in sent]
        ends = np.cumsum([0, *map(len, hashes)])
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = []
        for i in range(len(FIELDS)):
            totals.append(np.zeros(len(known), np.int64))
            for r, j, k in zip(sent, ends[:-1], ends[1:]):
                if r["data"][1 + i]:
                    # A row's words are distinct.
                    totals[-1][at[j:k]] += unpack(r["data"][1 + i])
        out = [(r["block"], WORDS, r["bucket"], [pack(x[at[j:k]]) for x in totals]) for r, j, k in zip(sent, ends[:-1], ends[1:]) if r["block"] is not None]
        size = int(np.count_nonzero((totals[1] > 0) & (known != OTHER)))
        return pa.Table.from_batches([_batch([*out, (None, VOCABULARY, size, [])], schema)])

    return rows.groupBy("bucket").applyInArrow(add, ROWS)


def _returned(right: pa.Table, kind: int, fields: int) -> list[np.ndarray]:
    """What the buckets of a kind returned to a block, one after the other by bucket."""
    rows = sorted((r["bucket"], r["data"]) for r in right.select(["kind", "bucket", "data"]).to_pylist() if r["kind"] == kind)
    return [np.concatenate([*(unpack(d[i]) for _, d in rows), np.empty(0, np.int64)]) for i in range(fields)]


def _of_words(b: Block, right: pa.Table, buckets: int) -> list[np.ndarray]:
    """The FIELDS of a block's words."""
    order = np.argsort((_mix(b.hashes) >> np.uint64(20)).astype(np.int64) % buckets, kind="stable")
    out = []
    for x in _returned(right, WORDS, len(FIELDS)):
        out.append(np.empty(len(order), np.int64))
        out[-1][order] = x
    return out


def fold(blocks: DataFrame, share: float, total: list[int], buckets: int, name: str) -> DataFrame:
    """The blocks with the words below the share of both corpora as one word, OTHER."""
    schema = _arrow(BLOCKS)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for r in left.to_pylist():
            b = Block.of(*(r[c] for c in _BLOB))
            ut, ub, *_ = _of_words(b, right, buckets)
            hashes = np.where(_kept(ut, ub, share, total) | (b.hashes == START), b.hashes, OTHER)
            rows.append(block_row(r["block"], r["doc_id"], b.size, b.target, b.word, hashes))
        return pa.Table.from_batches([_batch(rows, schema)])

    counted = word_totals(word_rows(blocks, buckets)).filter("block is not null")
    return persist_table(blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, BLOCKS), f"{name}-folded")


def score(blocks: DataFrame, totals: DataFrame, hot: tuple[np.ndarray, np.ndarray], buckets: int, word_buckets: int, v: int, total: list[int], share: float) -> DataFrame:
    """Blocks with the totals of their bigrams and words -> doc_id, n_tokens, target_loss, background_loss,
    score: sums of losses in nats, and their difference per token. A text without tokens scores 0."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            b = Block.of(*(r[c] for c in _BLOB))
            c, w, _, at, _ = b.bigrams(hot, buckets)
            pair = _returned(right, BIGRAMS, 2)
            kept = _kept(*pair, share, total)
            ut, ub, nt, nb, kt, kb, dt, db = _of_words(b, right, word_buckets)
            doc = b.of_token(np.arange(len(b.size)))
            sums = []
            for n, u, m, k, d, of in ((pair[0], ut, nt, kt, dt, total[0]), (pair[1], ub, nb, kb, db, total[1])):
                unigram = (u + ADD) / (of + ADD * (v + 1))
                mass = np.maximum(m, 1)
                rest = np.maximum(1 - (k - DISCOUNT * d) / mass, 1e-12)
                loss = -np.log(np.where(kept, np.maximum(n - DISCOUNT, 0.0), 0.0) / mass[c] + rest[c] * unigram[w])
                sums.append(np.bincount(doc, weights=loss[at], minlength=len(b.size)).astype(np.float64))
            out.append([r["doc_id"], b.size, *sums, (sums[0] - sums[1]) / np.maximum(b.size, 1)])
        give_back()
        return pa.concat_tables(pa.table([pa.array(x, y) for x, y in zip(part, schema.types)], schema=schema) for part in out) if out else schema.empty_table()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((x, pa.float64()) for x in ("target_loss", "background_loss", "score"))])
    return blocks.select("block", "doc_id", *_BLOB).groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, name: str = "xent", head: int = HEAD, word_share: float = WORD_SHARE,
                             bigram_share: float = BIGRAM_SHARE) -> DataFrame:
    """Score all documents; the target corpus is the documents whose ids are in ``target_ids``
    (doc_id), the background all documents. An empty target gives a uniform target model."""
    # The ids grow with the corpus: one shuffle join at every size, not a broadcast while they are few.
    # Rows without an id match none; they are dealt by their texts.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    base = id_text(docs).withColumn("spread", spread)
    ids = target_ids.select("doc_id").filter("doc_id is not null").distinct().select("doc_id", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("target"))
    marked = base.join(ids.hint("merge"), ["doc_id", "spread"], "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks = read_blocks(marked, name)
    total = [x or 0 for x in blocks.agg(F.sum("t"), F.sum("n")).first()]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, word_buckets = max(width, total[1] // PER_BUCKET), max(width, total[1] // PER_WORDS)
    if word_share:
        blocks = fold(blocks, word_share, total, word_buckets, name)
    # A context of more than 1/HOT of all tokens has at least half of them in blocks that list it; at most 2 HOT are found.
    listed = blocks.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("h")).groupBy("h.hot").agg(F.sum("h.hot_n").alias("n"))
    found = np.array(sorted(map(tuple, listed.filter(F.col("n") * 2 * HOT >= total[1]).collect())), np.int64).reshape(-1, 2)
    hot = found[:, 0], 1 + found[:, 1] * SPLIT * buckets // max(total[1], 1)
    counted = persist_table(bigram_totals(bigram_rows(blocks, hot, buckets), bigram_share, total, word_buckets), f"{name}-bigrams")
    known = persist_table(word_totals(word_rows(blocks, word_buckets).unionByName(counted.filter(F.col("kind") == WORDS))), f"{name}-words")
    v = known.filter(F.col("kind") == VOCABULARY).agg(F.sum("bucket")).first()[0] or 0
    totals = counted.filter(F.col("kind") == BIGRAMS).unionByName(known.filter(F.col("kind") == WORDS))
    return score(blocks, totals, hot, buckets, word_buckets, v, total, bigram_share)
