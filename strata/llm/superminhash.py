"""MinHash near-duplicates with SuperMinHash signatures.

Every shingle of a document draws a random permutation of the signature's slots
lazily (a Fisher-Yates walk seeded by the shingle's hash) and offers slot p[j]
the rank j plus a fraction; a slot keeps its least offer. The ranks of one shingle
differ between slots, so slots are negatively correlated and the estimate has a
lower variance than independent hashes; the walk ends as soon as j passes the
largest kept rank, after a few steps for all but very short texts.

Plan: one pass writes a row per document (set size, set key, band keys). Equal sets
collapse to one class each. Links are then found in rounds, so that a group of thousands of
near copies costs a pair per member, not all pairs: in every bucket (band, key) whose
members are not yet in one component, each member names the member of the smallest
component; of all its buckets' answers a document is compared with the commonest one, on
the full shingle sets. What is still in different components after the rounds and shares
buckets, directly or through others, forms a cluster; a cluster's documents are compared
exactly, by an inverted index over their shingles, in blocks of a bounded size, and only
links come out. Buckets, classes and stars are aggregates with map-side combine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import id_text, map_arrow
from strata.llm.components import components
from strata.llm.shingles import mix64, shingle_set, similar
from strata.session import persist_table

SLOTS, BAND_ROWS = 96, 4
#: Shingles walked together; bounds memory (SLOTS bytes each), not the text's length.
WALK = 100_000
#: Rounds of comparisons with one document, and documents of a block of the exact comparison.
ROUNDS, CLUSTER = 2, 3_000


def signatures(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (len(sets), m) as uint64: rank in the high half, fraction in the low."""
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    todo: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, s in enumerate(sets):
        for at in range(0, len(s), WALK):
            part = s[at : at + WALK]
            if size + len(part) > WALK and todo:
                _walk(sig, todo, m)
                todo, size = [], 0
            todo.append((i, part))
            size += len(part)
    if todo:
        _walk(sig, todo, m)
    return sig


def _walk(sig: np.ndarray, todo: list[tuple[int, np.ndarray]], m: int) -> None:
    doc = np.repeat([i for i, _ in todo], [len(s) for _, s in todo])
    seed = np.concatenate([s for _, s in todo])
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(seed), 1))
    flat = sig.reshape(-1)
    rows = np.arange(len(seed))
    for j in range(m):
        draw = mix64(seed[rows] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
        k = j + ((draw >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
        slot = perm[rows, k].copy()
        perm[rows, k] = perm[rows, j]
        offer = np.uint64(j << 32) | (mix64(draw) & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, doc[rows] * m + slot, offer)
        live = np.unique(doc[rows])
        open_ = live[sig[live].max(axis=1) >= np.uint64((j + 1) << 32)]
        rows = rows[np.isin(doc[rows], open_)] if len(open_) < len(live) else rows
        if not len(rows):
            return


def _bands(sig: np.ndarray, r: int) -> np.ndarray:
    """One 64-bit key per band of r slots, distinct between bands."""
    n, m = sig.shape
    out = np.zeros((n, m // r), np.uint64)
    for b in range(m // r):
        x = np.full(n, b + 1, np.uint64)
        for c in range(r):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * r + c])
        out[:, b] = x
    return out


def sign(docs: DataFrame, k: int, slots: int, band_rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): set_key is a 128-bit digest of the whole set."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bands = _bands(signatures(sets, slots), band_rows).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
             pa.array([x.tolist() if len(s) else [] for x, s in zip(bands, sets)], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "bands"])

    return map_arrow(id_text(docs), one, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; their sizes, which bound it, are compared first."""
    size = sets.select("doc_id", "n")
    pairs = (pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
             .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b"))
    full = sets.select("doc_id", "s")
    both = pairs.join(full.toDF("b", "sb"), "b").join(full.toDF("a", "sa"), "a")

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        sa, sb = b.column(2).to_pylist(), b.column(3).to_pylist()
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(sa, sb)]
        return b.select([0, 1]).filter(pa.array(ok))

    return persist_table(map_arrow(both.select("a", "b", "sa", "sb"), check, "a long, b long"), f"{name}-links")


def links_between(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components, one for each that is joined: every pair across components
    is counted through an inverted index, and each component is linked to another once."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(flat))
    shared = last - first > 1
    group = np.cumsum(new) - 1
    # Occurrences of shared shingles, by document.
    keep = shared[group]
    back = np.argsort(owner[keep], kind="stable")
    of = group[keep][back]
    cut = np.searchsorted(owner[keep][back], np.arange(len(sets) + 1))
    names, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
    main = int(np.argmax(counts))
    root = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i in np.flatnonzero(inverse != main):
        mine = of[cut[i] : cut[i + 1]]
        if not len(mine):
            continue
        n = last[mine] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (both > 0) & (comp != comp[i]))
        for j in near:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _rest(open_: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """open_ (key, rep, c): members of buckets with several components -> the links between them."""
    lead = open_.groupBy("key").agg(F.min("rep").alias("lead"))
    cluster = components(open_.join(lead, "key").select("rep", "lead"), f"{name}-clusters").toDF("rep", "k")
    members = persist_table(open_.select("rep", "c").distinct().join(cluster, "rep"), f"{name}-members")
    # A cluster of g blocks is compared block by block: a document goes to g pairs of blocks.
    blocks = members.groupBy("k").agg(F.ceil(F.count("*") / CLUSTER).cast("int").alias("g"))
    dealt = members.join(blocks, "k").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = dealt.select("k", "rep", "c", "i", other.alias("j")).select("k", "rep", "c", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    rows = dealt.join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        found = links_between(t["rep"].to_numpy(), t["c"].to_numpy(), [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()], percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return persist_table(rows.groupBy("k", "i", "j").applyInArrow(compare, "a long, b long"), f"{name}-rest")


def _open(buckets: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(key, rep, c): the members, with their components, of buckets that hold more than one component."""
    if comp is None:
        return buckets.select("key", "rep", F.col("rep").alias("c"))
    placed = buckets.join(comp.toDF("rep", "c"), "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return placed.join(mixed, "key")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, slots: int = SLOTS,
                    band_rows: int = BAND_ROWS, name: str = "minhash") -> DataFrame:
    """documents (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row per input row.

    Null, empty and white-space texts have an empty set, link with nothing and are kept.
    A null doc_id links with nothing: component_id is null and the row is kept. Repeated
    rows give the same row again. Bands of 4 slots of 96 miss a pair at similarity 0.8
    with probability (1 - 0.8^4)^24 = 3e-6.
    """
    base = id_text(docs)
    signed = persist_table(sign(docs, k, slots, band_rows), f"{name}-signed")
    classes = persist_table(
        signed.filter("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), f"{name}-classes")
    copies = signed.filter("doc_id is not null").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").filter("doc_id <> rep")
    rows = classes.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("key")
    buckets = persist_table(rows.join(shared, "key"), f"{name}-buckets")
    # Sets of the documents that share a bucket with another one; the others need none.
    texts = base.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = persist_table(map_arrow(texts, lambda b: pa.RecordBatch.from_arrays(
        [b.column(0), pa.array([shingle_set(t, k).tobytes() for t in b.column(1).to_pylist()], pa.binary())],
        names=["doc_id", "s"]), "doc_id long, s binary").dropDuplicates(["doc_id"]).withColumn("n", F.length("s") / 8), f"{name}-sets")
    comp, links, seen = None, None, None
    for turn in range(ROUNDS):
        open_ = persist_table(_open(buckets, comp), f"{name}-open")
        lead = open_.groupBy("key").agg(F.min(F.struct("c", "rep")).alias("lead")).select("key", F.col("lead.c").alias("lc"), F.col("lead.rep").alias("lead"))
        asked = open_.join(lead, "key").filter("c <> lc").groupBy(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"), "rep").agg(F.count("*").alias("n"))
        asked = asked if seen is None else asked.join(seen, ["a", "b"], "left_anti")
        best = asked.groupBy("rep").agg(F.max(F.struct("n", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x"))
        pairs = persist_table(best.select((-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b")).distinct(), f"{name}-pairs")
        found = _confirm(pairs, sets, percent, name)
        links, seen = (found, pairs) if links is None else (links.union(found), seen.union(pairs))
        comp = components(links, name)
    rest = _rest(persist_table(_open(buckets, comp), f"{name}-open"), sets, percent, name)
    # The rounds' components stand for their links.
    whole = components(comp.toDF("a", "b").union(rest).union(copies.toDF("a", "b")), f"{name}-all")
    out = signed.select("doc_id", "n_shingles").join(whole.toDF("doc_id", "component_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id is the smallest of their group, with their columns as they were;
    repeated rows stay repeated, rows without an id stay."""
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_id")).distinct()
    row = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("_row"))
    return row.join(gone, "_id", "left_anti").select("_row.*")
