"""Prefix trie of conversations as a burst trie.

Rebuilt conversations that are equal turn by turn become one sequence of turn ids with a weight.
A container holds the suffixes of all sequences below one trie head (a prefix); it starts as one
container under the root. A container of more than ``LIMIT`` turns bursts: it moves on to the depth
where its members first part (their common prefix is that of the least and the greatest), and its
members go to containers by their next turn id. What bursts becomes a path of trie nodes; the
containers that remain are sorted, and one sweep over each gives its nodes. Sums of the heads
come from the containers below them by an aggregate over each container's list of heads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.session import persist_table

#: A conversation takes its first turns from the one at the start of its block of BLOCK ids: at most MAX_TAKEN.
BLOCK, MAX_TAKEN = 5, 8
#: Turns of a container that is swept as it is.
LIMIT = 20_000
#: Conversation ids whose list is made in one piece (2^SPAN of them at most).
SPAN = 12
#: Rows of a table that may be broadcast (a few short columns a row).
MAX_HEADS = 100_000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, ids array<string>, sizes array<int>):
    a row per conv_id, its rebuilt turns as digests of (role, text) and bytes of text.

    Turns go by turn (null first), equal turns by their digest; a null role or text is empty; rows
    without a conv_id are in no conversation. A conversation is one row of its turns' ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"), F.octet_length(text).alias("size"))
    own = persist_table(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("t"))
                        .select("conv_id", F.expr("transform(t, x -> struct(x.id, x.size))").alias("t")), "conversations")
    base = own.select(F.col("conv_id").alias("base"), F.expr(f"slice(t, 1, {MAX_TAKEN})").alias("lead"))
    joined = (own.withColumn("h", F.expr("crc32(cast(cast(conv_id as string) as binary)) % 9").cast("int"))
              .withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(base, "base", "left"))
    both = F.expr("concat(coalesce(slice(lead, 1, h), array()), slice(t, h + 1, size(t)))")
    return joined.select("conv_id", both.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def _ends(members: DataFrame) -> DataFrame:
    """(sid, conv_id) -> (sid, n, first, ends): per sequence its conversations' number, the smallest
    and the SHA-256 of their ids. Lists are made per range of ids, then hashed in order, a row a range."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = members.groupBy("sid", F.shiftright("conv_id", SPAN).alias("span")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, n, first, sha = None, 0, None, hashlib.sha256()
        out: list[tuple] = []
        for b in batches:
            for s, k, f, text in zip(*(b.column(c).to_pylist() for c in ("sid", "n", "first", "ids"))):
                if s != sid:
                    if sid is not None:
                        out.append((sid, n, first, sha.hexdigest()))
                    sid, n, first, sha = s, 0, f, hashlib.sha256()
                elif n:
                    sha.update(b",")
                sha.update(text.encode())
                n += k
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("sid", "n", "first", "ends"), r)) for r in out])
                out = []
        if sid is not None:
            yield pa.RecordBatch.from_pylist([{"sid": sid, "n": n, "first": first, "ends": sha.hexdigest()}])

    ordered = pieces.repartition("sid").sortWithinPartitions("sid", "span").select("sid", "n", "first", "ids")
    return ordered.mapInArrow(run, "sid string, n long, first long, ends string")


def sequences(conversations: DataFrame) -> DataFrame:
    """The distinct rebuilt sequences: sid, ids, sizes, n (conversations), first (the smallest), ends."""
    whole = persist_table(rebuilt(conversations).withColumn("sid", F.md5(F.array_join("ids", ",").cast("binary"))), "rebuilt")
    found = _ends(whole.select("sid", "conv_id"))
    turns = whole.select(F.col("conv_id").alias("first"), "ids", "sizes")
    return persist_table(found.join(turns, "first").select("sid", "ids", "sizes", "n", "first", "ends"), "sequences")


_SWEPT = ("key string, parent string, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string, top boolean")


class _Container:
    """Sorted suffixes of one container, swept into nodes."""

    def __init__(self, key: str, parent: str | None, depth: int):
        self.key, self.parent, self.depth = key, parent, depth
        self.rows: list[list] = []  # node: parent's number, depth, first, n, children, leaves, saved, ends, bytes
        self.open: list[int] = []
        self.last: list[str] = []

    def _start(self, depth: int, size: int) -> None:
        self.rows.append([self.open[-1] if self.open else None, depth, None, 0, 0, 0, 0, EMPTY_SHA, size])
        self.open.append(len(self.rows) - 1)

    def _close(self) -> None:
        node = self.rows[self.open.pop()]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[8]
        if self.open:
            up = self.rows[self.open[-1]]
            up[2] = node[2] if up[2] is None else min(up[2], node[2])
            up[3] += node[3]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]

    def add(self, ids: list[str], sizes: list[int], n: int, first: int, ends: str) -> None:
        common = self.depth
        if not self.open:
            self._start(self.depth, sizes[self.depth - 1] if self.depth else 0)
        else:
            end = min(len(ids), len(self.last))
            while common < end and ids[common] == self.last[common]:
                common += 1
        while len(self.open) - 1 > common - self.depth:
            self._close()
        for d in range(common + 1, len(ids) + 1):
            self._start(d, sizes[d - 1])
        node = self.rows[self.open[-1]]
        node[2] = first if node[2] is None else min(node[2], first)
        node[3] += n
        node[7] = ends
        self.last = ids

    def nodes(self) -> Iterator[tuple]:
        while self.open:
            self._close()
        for up, depth, first, n, children, leaves, saved, ends, _ in self.rows:
            yield self.key, self.parent, depth, first, None if up is None else self.rows[up][2], n, children, leaves, saved, ends, up is None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _SWEPT.split(", ")]
    held: _Container | None = None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return done

    for b in batches:
        for key, parent, depth, ids, sizes, n, first, ends in zip(*(c.to_pylist() for c in b.columns)):
            if held is None or held.key != key:
                if held is not None:
                    out.extend(held.nodes())
                held = _Container(key, parent, depth)
            held.add(ids, sizes, n, first, ends)
            if len(out) >= 10_000:
                yield batch()
    if held is not None:
        out.extend(held.nodes())
    if out:
        yield batch()


def _key(depth: str) -> str:
    """A container's name: the digest of the prefix that its members share."""
    return f"md5(cast(array_join(slice(ids, 1, {depth}), ',') as binary))"


def _bounded(heads: DataFrame) -> DataFrame:
    return F.broadcast(heads) if heads.count() <= MAX_HEADS else heads


def burst(seqs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[DataFrame]]:
    """Containers' members (key, parent, depth, path, ...) and, per round, the heads that burst:
    key, parent, path (the heads above), depth and last (of their path of nodes), n, first, sizes, own ends."""
    none = F.lit(None).cast("string")
    pending = seqs.select("*", F.lit("").alias("key"), none.alias("parent"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"))
    heads: list[DataFrame] = []
    settled: list[DataFrame] = []
    while True:
        sized = pending.groupBy("key", "parent", "depth", "path").agg(
            F.count("*").alias("members"), F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.sum("n").alias("n"), F.min("first").alias("first"),
            F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"))
        # Members are distinct, so the least and the greatest part somewhere.
        common = F.expr("cast(array_position(zip_with(lo.ids, hi, (x, y) -> x <=> y), false) as int) - 1")
        over = persist_table(sized.filter((F.col("members") > 1) & (F.col("turns") > limit)).withColumn("last", common)
                             .select("key", "parent", "path", "depth", "last", "n", "first", F.expr("slice(lo.sizes, 1, last)").alias("sizes")), "burst-heads")
        if over.isEmpty():
            settled.append(pending)
            break
        heads.append(over)
        marks = _bounded(over.select("key", "last"))
        settled.append(pending.join(marks.select("key"), "key", "left_anti"))
        moved = pending.join(marks, "key").select(
            *seqs.columns, F.col("key").alias("parent"), (F.col("last") + 1).alias("depth"),
            F.concat("path", F.array("key")).alias("path")).withColumn("key", F.expr(_key("depth")))
        pending = persist_table(moved, "burst-members")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out, heads


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per trie node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Without conversations there is no root either.

    A sequence that ends where a container bursts stays with the burst head as its end.
    """
    seqs = sequences(conversations)
    members, bursts = burst(seqs, limit)
    if not bursts:
        return _result(_swept(members))
    heads = bursts[0]
    for h in bursts[1:]:
        heads = heads.unionByName(h)
    # Sequences that end at a head's last node: they were moved one turn beyond their end.
    inside = members.filter("size(ids) >= depth")
    ended = members.filter("size(ids) < depth").select(F.col("parent").alias("key"), F.col("ends").alias("own_ends"))
    swept = persist_table(_swept(inside), "swept")
    tops = swept.filter("top")
    paths = inside.select("key", "path").distinct()
    below = tops.join(paths, "key").select("path", F.col("parent").alias("above"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    # A head's own nodes save (n - 1) texts each, which counts for it and for the heads above.
    own = F.expr("(n - 1) * aggregate(slice(sizes, greatest(depth, 1), last - greatest(depth, 1) + 1), 0L, (s, x) -> s + x)")
    through = heads.select("path", F.col("parent").alias("above"), F.lit(0).cast("long").alias("leaves"), own.alias("saved"))
    sums = (below.unionByName(through).select(F.explode("path").alias("key"), "above", "leaves", "saved").groupBy("key")
            .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.sum((F.col("above") == F.col("key")).cast("long")).alias("children")))
    named = persist_table(heads.join(sums, "key").join(ended, "key", "left"), "heads")
    firsts = named.select(F.col("key").alias("parent"), F.col("first").alias("up"))
    path = named.join(firsts, "parent", "left").withColumn("d", F.explode(F.sequence("depth", "last")))
    part = F.expr("(n - 1) * aggregate(slice(sizes, greatest(d, 1), last - greatest(d, 1) + 1), 0L, (s, x) -> s + x)")
    at_last = F.col("d") == F.col("last")
    head_nodes = path.select(
        F.col("first").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("depth"), F.col("first")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + part).alias("saved_tokens"), F.when(at_last, F.coalesce("own_ends", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"))
    linked = tops.join(firsts, "parent", "left").withColumn("parent_conv_id", F.col("up"))
    return _result(swept.filter("not top")).unionByName(_result(linked)).unionByName(_result(head_nodes))


def _result(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", "ends_sha256")


def _swept(members: DataFrame) -> DataFrame:
    """The nodes of the containers: suffixes sorted by Spark, swept in order."""
    rows = members.select("key", "parent", "depth", "ids", "sizes", "n", "first", "ends")
    return rows.repartition("key").sortWithinPartitions("key", "ids").mapInArrow(_sweep, _SWEPT)
