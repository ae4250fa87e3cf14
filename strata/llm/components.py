"""Connected components of an edge table by alternating star contraction.

Union-find inside every partition first shrinks a partition's edges to one edge per
node. Where at most LOCAL_EDGES are left in all, one more pass over them ends the work; otherwise each round is a large-star and a small-star step, each an aggregate (with map-side combine, so a hub's rows collapse before the shuffle)
and a join. The edge table is written to the shared folder after each round, so
lineage stays short and a lost executor re-reads files. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.session import persist_table

MAX_ROUNDS = 60
#: Edges held by one partition's union-find at a time.
LOCAL_EDGES = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())],
                                          names=["u", "v"])

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(a), find(c)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += b.num_rows
        if seen >= LOCAL_EDGES:
            yield flush()
            seen = 0
    if parent:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: a node's larger neighbours move to its smallest neighbour
    (or itself); small: its smaller neighbours and itself do."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = near.join(low, "u")
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    rest = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b longs; null ends and loops ignored) -> (id, component): one row per node
    of some edge with the smallest id reachable from it."""
    e = (edges.toDF("a", "b").filter("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    e = persist_table(e.mapInArrow(_forest, "u long, v long"), name)
    if e.count() <= LOCAL_EDGES:
        e = persist_table(e.coalesce(1).mapInArrow(_forest, "u long, v long"), name)
        return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    e = e.distinct()
    for _ in range(MAX_ROUNDS):
        e = _star(_star(e, True), False).filter("u <> v").distinct()
        e = persist_table(e, name)
        # Settled: a star forest, that is every node has one edge, to a node that has none.
        several = e.groupBy("u").count().filter("count > 1").select("u")
        chained = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if several.union(chained).isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
