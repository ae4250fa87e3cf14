"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors that lie in one small ball (half the linking angle around its centre) are all
linked with each other, so a dense group of any size is kept as one vertex with a weight.
Vertices are dealt to their nearest cluster centres, several each; every cluster shard
builds a robust-pruned graph of bounded degree; the adjacency lists of a vertex from all
its shards are united. In each shard, greedy searches start from the shard's medoid and
the vertex itself and go on from every vertex within the range, which is widened by the
balls' radii. Found pairs of balls are verified in double precision: as a whole where the
angles leave no doubt, else member by member, in blocks. A sample of vectors is then compared
with all vectors outside their balls, since only those links are searched for; while the search
misses some, it is repeated with more overlap and a wider beam, and at last it fails.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from strata.llm.components import components
from strata.session import persist_table

THRESHOLD = 0.95
#: Vertices of a shard, shards a vertex goes to, sample the centres are fitted on, most centres.
SHARD, OVERLAP, SAMPLE, MAX_CENTRES = 1500, 4, 20_000, 8192
#: Shards of more vertices than WIDE are split by centres of their own, fitted on about SPLIT_SAMPLE of their
#: vertices; a vertex goes to the nearest SPLIT_OVERLAP of those.
WIDE, SPLIT_SAMPLE, SPLIT_OVERLAP = 12_000, 2000, 2
#: Members of each of two balls compared in one group.
PIECE = 4096
#: Out-degree, candidates per vertex, slack of the pruning rule, width of the greedy search.
DEGREE, CANDIDATES, ALPHA, BEAM = 12, 32, 1.2, 12
#: Vectors with links beyond their ball that the audit wants, most vectors it draws for them, the mean
#: recall below which the overlap is doubled, and the searches before the job fails.
AUDIT, MOST_DRAWN, ENOUGH, TURNS = 200, 12_800, 0.99, 5
_SLACK = 1e-6


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@F.arrow_udf(BinaryType())
def _unit(v: pa.Array) -> pa.Array:
    return pa.array([_units(np.asarray(x.values, dtype=np.float64)[None])[0].tobytes() for x in v], pa.binary())


def centres(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of n clusters of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def balls(x: np.ndarray, radius: np.ndarray, limit: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Disjoint groups (members, centre, radius) of unit vectors that have radii of their own: each
    member's angle to the centre plus its radius is at most the limit."""
    left = np.ones(len(x), bool)
    out = []
    for i in range(len(x)):
        if not left[i]:
            continue
        rows = np.flatnonzero(left)
        near = rows[_angle(x[rows] @ x[i]) + radius[rows] <= 2 * limit]
        centre = _units(x[near].sum(axis=0, keepdims=True))[0] if len(near) > 1 else x[i]
        for c in (centre, x[i]):
            reach = _angle(x[rows] @ c) + radius[rows]
            mine = rows[reach <= limit]
            if i in mine:
                break
        else:
            mine, c, reach = np.array([i]), x[i], radius[rows]
            rows = mine
        r = float(reach[np.isin(rows, mine)].max()) if len(mine) > 1 or radius[i] else 0.0
        left[mine] = False
        out.append((mine, c, r))
    return out


def prune(order: np.ndarray, dist: np.ndarray, between: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Robust pruning: of candidates in order of distance, drop those that a kept one is closer to by alpha."""
    kept: list[int] = []
    alive = np.ones(len(order), bool)
    for k in range(len(order)):
        if alive[k]:
            kept.append(int(order[k]))
            if len(kept) == degree:
                break
            alive &= alpha * between[k] > dist
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[list[int]]:
    """Adjacency lists of a robust-pruned graph over unit vectors: out-edges and pruned back-edges."""
    n = len(x)
    if n < 2:
        return [[] for _ in range(n)]
    k = min(candidates, n - 1)
    rng = np.random.default_rng(n)
    near = np.empty((n, k), np.int64)
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        near[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]

    def choose(i: int, cand: np.ndarray) -> list[int]:
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[cand] @ x[i])))
        o = np.argsort(d, kind="stable")
        cand, d = cand[o], d[o]
        between = np.sqrt(np.maximum(0, 2 - 2 * (x[cand] @ x[cand].T)))
        return prune(cand, d, between, degree, alpha)

    out = [choose(i, np.append(near[i], rng.integers(0, n, 4))) for i in range(n)]
    out = [[j for j in row if j != i] for i, row in enumerate(out)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row:
            back[j].append(i)
    for i in range(n):
        both = list(dict.fromkeys(out[i] + back[i]))
        out[i] = both if len(both) <= 2 * degree else choose(i, np.array(both))
    return out


def range_search(x: np.ndarray, graph: list[np.ndarray], starts: list[int], query: np.ndarray, reach: float, beam: int = BEAM) -> list[int]:
    """Vertices within an angle of the query: greedy search from the starts with a beam, then on
    from every vertex within the range until none is new."""
    low = math.cos(reach)
    seen = set(starts)
    sims = x[starts] @ query
    heap = [(-float(s), v) for s, v in zip(sims, starts)]
    heapq.heapify(heap)
    best = sorted((float(s) for s in sims), reverse=True)[:beam]
    found = [v for s, v in zip(sims, starts) if s >= low]
    while heap:
        s, v = heapq.heappop(heap)
        if -s < low and len(best) >= beam and -s < best[-1]:
            break
        new = [w for w in graph[v] if w not in seen]
        if not new:
            continue
        seen.update(new)
        sims = x[new] @ query
        for t, w in zip(sims.tolist(), new):
            heapq.heappush(heap, (-t, w))
            if t >= low:
                found.append(w)
        best = sorted(best + sims.tolist(), reverse=True)[:beam]
    return found


def _valid(embeddings: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """One row per id (the least vector, if an id has several) with a finite vector that is not zero,
    of the commonest length; and that length."""
    v = F.col("v")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = rows.filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 0
    return rows.filter(F.size("v") == dim), dim


def _split(dealt: DataFrame, dim: int, wide: int) -> DataFrame:
    """dealt (vertex, c, r, turn, shard) with sub: the part of the shard, several rows a vertex in a split shard."""
    sizes = dealt.groupBy("shard").count().filter(F.col("count") > wide)
    drawn = dealt.join(F.broadcast(sizes), "shard").filter(F.pmod(F.xxhash64("vertex"), F.ceil(F.col("count") / SPLIT_SAMPLE)) == 0)

    def fit(t: pa.Table) -> pa.Table:
        x, n = _matrix(t.sort_by("vertex")["c"], dim), t["count"][0].as_py()
        mid = centres(x, min(max(2, -(-n * 2 * SPLIT_OVERLAP // wide)), len(x)))
        return pa.table({"shard": t["shard"].slice(0, 1), "mid": pa.array([mid.tobytes()], pa.binary())})

    fitted = drawn.select("shard", "count", "vertex", "c").groupBy("shard").applyInArrow(fit, "shard int, mid binary")

    @F.arrow_udf("array<int>")
    def nearest(c: pa.Array, mid: pa.Array) -> pa.Array:
        own = [np.frombuffer(m, np.float64).reshape(-1, dim) @ np.frombuffer(v, np.float64) if m else np.zeros(1) for v, m in zip(c.to_pylist(), mid.to_pylist())]
        return pa.array([np.argsort(-x, kind="stable")[:SPLIT_OVERLAP].tolist() for x in own], pa.list_(pa.int32()))

    return dealt.join(fitted, "shard", "left").select("vertex", "c", "r", "turn", "shard", F.explode(nearest("c", "mid")).alias("sub"))


def _search(vertices: DataFrame, mid: np.ndarray, dim: int, overlap: int, reach: float, name: str, beam: int = BEAM, wide: int = WIDE) -> DataFrame:
    """vertices (vertex, c, r) -> found pairs (a, b), a < b, whose balls may hold linked members."""
    take = min(overlap, len(mid))

    @F.arrow_udf("array<int>")
    def nearest(c: pa.Array) -> pa.Array:
        x = _matrix(c, dim) @ mid.T
        return pa.array(np.argsort(-x, axis=1, kind="stable")[:, :take].tolist(), pa.list_(pa.int32()))

    dealt = vertices.select("vertex", "c", "r", F.posexplode(nearest("c")).alias("turn", "shard"))
    dealt = persist_table(_split(persist_table(dealt, f"{name}-dealt"), dim, wide), f"{name}-shards")

    def build(t: pa.Table) -> pa.Table:
        ids, x = t["vertex"].to_numpy(), _matrix(t["c"], dim)
        graph = build_graph(x)
        return pa.table({"vertex": pa.array(ids), "near": pa.array([ids[row].tolist() for row in graph], pa.list_(pa.int64()))})

    lists = dealt.groupBy("shard", "sub").applyInArrow(build, "vertex long, near array<long>")
    united = lists.groupBy("vertex").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = dealt.join(united, "vertex")

    def search(t: pa.Table) -> pa.Table:
        ids, x, r, turn = t["vertex"].to_numpy(), _matrix(t["c"], dim), t["r"].to_numpy(), t["turn"].to_numpy()
        at = {int(v): i for i, v in enumerate(ids)}
        graph = [[at[w] for w in row if w in at] for row in t["near"].to_pylist()]
        medoid = int(np.argmax(x @ x.sum(axis=0)))
        widest, a, b = float(r.max()), [], []
        for i in range(len(ids)):
            found = range_search(x, graph, list({medoid, i}), x[i], reach + float(r[i]) + widest + _SLACK, beam)
            f = np.array(found, np.int64)
            f = f[(f != i) & (_angle(x[f] @ x[i]) <= reach + r[i] + r[f] + _SLACK)]
            a += [int(ids[i])] * len(f)
            b += ids[f].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = ready.groupBy("shard", "sub").applyInArrow(search, "a long, b long")
    return persist_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-found")


def _verify(pairs: DataFrame, vertices: DataFrame, members: DataFrame, dim: int, threshold: float, reach: float, name: str, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(links of members beyond their ball: rep, n), (edges between balls: a, b). Each direction of a
    pair is counted by itself: a member that is surely linked with all or none of the other ball
    is settled by one angle. Of the rest, those of one ball are compared with those of the other in
    pieces of bounded size; members of the other that are surely linked with the whole ball are added."""
    ball = vertices.select("vertex", "c", "r", "weight")
    both = pairs.union(pairs.select("b", "a")).toDF("p", "q")
    rows = (both.join(members.select(F.col("vertex").alias("p"), "rep", "mult", "u"), "p")
            .join(ball.toDF("q", "c", "r", "weight"), "q"))

    @F.arrow_udf("int")
    def settle(u: pa.Array, c: pa.Array, r: pa.Array) -> pa.Array:
        a, r = _angle(np.einsum("ij,ij->i", _matrix(u, dim), _matrix(c, dim))), np.asarray(r)
        sure = (a + r <= reach - _SLACK) & (r > 0)
        return pa.array(np.where(a - r > reach + _SLACK, 0, np.where(sure, 1, 2)).astype(np.int32))

    rows = persist_table(rows.withColumn("how", settle("u", "c", "r")).filter("how > 0").select("p", "q", "rep", "mult", "u", "weight", "how"), f"{name}-rows")
    sure = rows.filter("how = 1").select("p", "q", "rep", F.col("weight").alias("n"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, mult = _matrix(left["u"], dim), _matrix(right["u"], dim), right["mult"].to_numpy()
        n = np.zeros(len(x), np.int64)
        for j in range(0, len(y), 2048):
            for i in range(0, len(x), 2048):
                n[i : i + 2048] += (x[i : i + 2048] @ y[j : j + 2048].T >= threshold) @ mult[j : j + 2048]
        return pa.table({"p": left["p"], "q": left["q"], "rep": left["rep"], "n": pa.array(n)})

    open_ = rows.filter("how = 2")
    # One row per direction of a pair of balls.
    whole = rows.filter("how = 1").groupBy(F.col("q").alias("p"), F.col("p").alias("q")).agg(F.sum("mult").alias("n"))
    some = open_.select("p", "q", "rep").join(whole, ["p", "q"]).select("p", "q", "rep", "n")
    pieces = persist_table(open_.groupBy("p", "q").agg(F.ceil(F.count("*") / piece).alias("here")), f"{name}-pieces")
    # Only pairs of balls that both have such members.
    pieces = pieces.join(pieces.select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("here").alias("there")), ["p", "q"])
    dealt = open_.join(pieces, ["p", "q"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("here")))
    dealt = dealt.select("p", "q", "rep", "mult", "u", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("there") - 1)).alias("other"))
    left = dealt.select("p", "q", "mine", "other", "rep", "u")
    right = dealt.select("q", "p", "other", "mine", "mult", "u").toDF("p", "q", "mine", "other", "mult", "u")
    key = ["p", "q", "mine", "other"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "p long, q long, rep long, n long")
    links = persist_table(sure.union(some).union(near.filter("n > 0")), f"{name}-links")
    return links.groupBy("rep").agg(F.sum("n").alias("n")), links.select("p", "q").distinct()


def audit(members: DataFrame, dim: int, beyond: DataFrame, threshold: float, wanted: int = AUDIT, most: int = MOST_DRAWN) -> float | None:
    """Mean over vectors of the share of their links beyond their ball that was counted. Vectors are drawn
    by hash, four times as many while fewer than wanted have such links, and compared with every
    vector; None: none of the vectors drawn (all, or the most that are) has one."""
    drawn = members.orderBy(F.xxhash64("rep"), "rep")
    size = wanted
    while True:
        sample = drawn.limit(size).join(beyond, "rep", "left").select("vertex", "u", F.coalesce("n", F.lit(0)).alias("n")).collect()
        if not sample:
            return None
        q = np.frombuffer(b"".join(bytes(r.u) for r in sample), np.float64).reshape(-1, dim)
        of = np.array([r.vertex for r in sample])

        def count(batches):
            n = np.zeros(len(q), np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    near = (q @ _matrix(part.column(0), dim).T >= threshold) & (of[:, None] != part.column(1).to_numpy())
                    n += near @ part.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(q)), pa.int32()), pa.array(n)], names=["i", "n"])

        found = members.select("u", "vertex", "mult").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
        shares = [min(sample[r.i].n, r.n) / r.n for r in found if r.n]
        if len(shares) >= wanted or len(sample) < size or size >= most:
            return float(np.mean(shares)) if shares else None
        size = min(4 * size, most)


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                 shard: int = SHARD, overlap: int = OVERLAP, name: str = "flat-graph", piece: int = PIECE, wide: int = WIDE) -> DataFrame:
    """embeddings -> vec_id, n_links, component_id, kept: one row per distinct id and per row without one.

    Vectors that are null, empty, zero or hold null or non-finite components, or whose length is not
    the table's commonest, link with nothing, as do rows without an id (component_id null). An id
    with several vectors counts with the least of them.
    """
    valid, dim = _valid(embeddings, id_col, vec_col)
    valid = persist_table(valid.withColumn("u", _unit("v")).select("vec_id", "u"), f"{name}-units")
    everyone = embeddings.select(F.col(id_col).cast("long").alias("vec_id"))
    ids = everyone.filter("vec_id is not null").distinct().union(everyone.filter("vec_id is null"))
    empty = F.lit(0).cast("long")
    if dim == 0:
        return ids.select("vec_id", empty.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    reach = math.acos(threshold)
    half = reach / 2 - _SLACK
    # Equal directions are one row with a multiplicity.
    classes = persist_table(valid.groupBy("u").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), f"{name}-classes")
    n = classes.count()
    sample = np.frombuffer(b"".join(bytes(r.u) for r in classes.orderBy(F.xxhash64("rep"), "rep").select("u").limit(SAMPLE).collect()), np.float64).reshape(-1, dim)
    mid = centres(sample, min(max(1, n // shard), max(1, len(sample) // 4), MAX_CENTRES))

    @F.arrow_udf("int")
    def home(u: pa.Array) -> pa.Array:
        return pa.array(np.argmax(_matrix(u, dim) @ mid.T, axis=1).astype(np.int32))

    # Balls within hash parts of a cluster first, so that a hot cluster is many tasks; then of the parts' balls.
    homed = persist_table(classes.withColumn("home", home("u")), f"{name}-homes")
    parts = homed.groupBy("home").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("parts"))
    dealt = homed.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids, x = t["rep"].to_numpy(), _matrix(t["u"], dim)
        got = balls(x, np.zeros(len(x)), half)
        at = np.empty(len(x), np.int64)
        for k, (m, _, _) in enumerate(got):
            at[m] = k
        low = np.array([ids[m].min() for m, _, _ in got])
        pick = lambda f: [f(got[k]) for k in at]
        return pa.table({"home": t["home"], "rep": t["rep"], "mult": t["mult"], "u": t["u"], "ball": pa.array(low[at]),
                         "c": pa.array(pick(lambda g: g[1].tobytes()), pa.binary()), "r": pa.array(pick(lambda g: g[2]), pa.float64())})

    small = persist_table(dealt.groupBy("home", "part").applyInArrow(first, "home int, rep long, mult long, u binary, ball long, c binary, r double"), f"{name}-balls")
    firsts = small.groupBy("home", "ball").agg(F.first("c").alias("c"), F.first("r").alias("r"), F.count("*").alias("size"))
    split = parts.filter("parts > 1").select("home")

    def second(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("ball", "ascending")])
        ids, got = t["ball"].to_numpy(), balls(_matrix(t["c"], dim), t["r"].to_numpy(), half)
        rows = [(int(i), int(ids[m].min()), c.tobytes(), r) for m, c, r in got for i in ids[m]]
        return pa.table(dict(zip(("ball", "vertex", "c", "r"), (pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.float64()))))))

    # Dense parts have few balls; groups of balls are dealt by hash again, so none is unbounded.
    groups = firsts.join(split, "home").join(firsts.groupBy("home").agg(F.ceil(F.count("*") / (4 * shard)).cast("int").alias("g")), "home")
    merged = groups.groupBy("home", F.pmod(F.xxhash64("ball"), F.col("g")).alias("k")).applyInArrow(
        lambda t: second(t), "ball long, vertex long, c binary, r double")
    same = firsts.join(split, "home", "left_anti").select("ball", F.col("ball").alias("vertex"), "c", "r")
    of_ball = persist_table(same.union(merged), f"{name}-merged")
    members = persist_table(small.select("rep", "mult", "u", "ball").join(of_ball.select("ball", "vertex"), "ball").drop("ball"), f"{name}-members")
    vertices = persist_table(of_ball.groupBy("vertex").agg(F.first("c").alias("c"), F.max("r").alias("r")).join(
        members.groupBy("vertex").agg(F.sum("mult").alias("weight")), "vertex"), f"{name}-vertices")
    for turn in range(TURNS):
        pairs = _search(vertices, mid, dim, overlap << turn, reach, name, BEAM << turn, wide)
        beyond, edges = _verify(pairs, vertices, members, dim, threshold, reach, name, piece)
        recall = audit(members, dim, beyond, threshold)
        if recall is None or recall >= ENOUGH:
            break
    else:
        raise RuntimeError(f"{name}: the search finds {recall:.4f} of a vector's links beyond its ball, less than {ENOUGH}, at overlap {overlap << turn}")
    counted = (members.join(vertices.select("vertex", "weight"), "vertex").join(beyond, "rep", "left")
               .select("rep", "vertex", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    comp = components(edges.toDF("a", "b"), name)
    per_vector = (valid.join(classes.select("u", "rep"), "u").join(counted, "rep").join(comp.toDF("vertex", "c"), "vertex", "left")
                  .select("vec_id", "n_links", F.coalesce("c", "vertex").alias("component_id")))
    per_vector = persist_table(per_vector, f"{name}-result")
    out = ids.join(per_vector, "vec_id", "left").select("vec_id", F.coalesce("n_links", empty).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
