"""Seeded order inside groups, without a whole-group window.

The order of a row inside its group is ``(md5(seed:salt:id), id)``. A window
partitioned by the group alone would put a huge class into one task, so the
work is split:

* a histogram ``(group, bucket) -> count`` on the leading hex digits of the key
  (map-side combined; at most 16**digits rows per group) gives every bucket's
  offset inside its group;
* for a top-k cut, the histogram is reduced to one row per group: the bucket
  that straddles k. Rows in earlier buckets are in, later ones out, and only
  the straddling bucket is ranked;
* where exact ranks are needed, ``row_number`` runs inside ``(group, bucket)``
  partitions, so the largest window partition holds about n / 4096 rows of the
  largest class, and the join to the offsets shares that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions.hashing import bucket_of, seed_key
from strata.operators.dims import Dim, derive, join_dim

BUCKET_DIGITS = 3
MAX_DIGITS = 8
TARGET_BUCKET_ROWS = 50_000


def bucket_digits(largest_group: int, target: int = TARGET_BUCKET_ROWS) -> int:
    """Hex digits of the bucket key so that the largest group's buckets hold
    about ``target`` rows (at least 3 digits): the straddling bucket, the only
    one that is shuffled into a window, stays small even when one class holds
    a third of all rows (3e10 rows -> 5 digits -> ~30k rows per bucket)."""
    d = BUCKET_DIGITS
    while d < MAX_DIGITS and largest_group / 16 ** d > target:
        d += 1
    return d


def digits_for(sizes: Dim, n_col: str = "n") -> int:
    """Bucket digits for groups sized by a (small, cached) size table."""
    largest = sizes.df.agg(F.max(n_col)).first()[0] or 0
    return bucket_digits(int(largest))
_HELPERS = ("_key", "_b", "_cb", "_before", "_k", "_cnt")


def with_order_key(df: DataFrame, seed, id_col: str = "id", salt: Sequence = (),
                   digits: int = BUCKET_DIGITS) -> DataFrame:
    key = seed_key(seed, *[F.col(s) if isinstance(s, str) else s for s in salt], F.col(id_col))
    return df.withColumn("_key", key).withColumn("_b", bucket_of(F.col("_key"), digits))


def _offsets(d: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, _b, _cnt, _before): rows of the group in earlier buckets."""
    hist = d.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).cast("bigint"))


def _cut(d: DataFrame, groups: Sequence[str], quota: Dim, k_col: str) -> tuple[Dim, DataFrame]:
    """One row per group with k >= 1: the straddling bucket ``_cb`` and its offset."""
    # Both tables are bounded (groups x 16**digits and one row per group) and
    # each is read by two branches, so they are kept rather than recomputed.
    offs = join_dim(_offsets(d, groups), quota, list(groups)).persist()
    k = F.col(k_col)
    cut = (offs.filter((F.col("_before") < k) & (F.col("_before") + F.col("_cnt") >= k))
           .select(*groups, F.col("_b").alias("_cb"), "_before", k.alias("_k"))).persist()
    return derive(quota, cut), offs


def _rank(groups: Sequence[str], id_col: str):
    return F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_key", id_col))


def rank_within(df: DataFrame, groups: Sequence[str], seed, id_col: str = "id",
                salt: Sequence = (), rank_col: str = "rank", digits: int = BUCKET_DIGITS) -> DataFrame:
    """Exact 1-based rank of every row inside ``groups`` by (md5 key, id)."""
    groups = list(groups)
    d = with_order_key(df, seed, id_col, salt, digits)
    offs = _offsets(d, groups).drop("_cnt")
    joined = d.join(offs, [*groups, "_b"])
    ranked = joined.withColumn(rank_col, (F.col("_before") + _rank(groups, id_col)).cast("bigint"))
    return ranked.drop(*_HELPERS)


def take_ranked(df: DataFrame, groups: Sequence[str], quota: Dim, seed,
                id_col: str = "id", salt: Sequence = (), k_col: str = "k",
                rank_col: str | None = "rank", digits: int = BUCKET_DIGITS) -> DataFrame:
    """Rows whose seeded rank inside ``groups`` is at most the group's quota.

    ``quota`` holds ``groups`` + ``k_col``; groups without a row keep nothing.
    With ``rank_col`` the exact rank of each kept row is attached.
    """
    groups = list(groups)
    d = with_order_key(df, seed, id_col, salt, digits)
    cut, offs = _cut(d, groups, quota, k_col)
    sel = join_dim(d, cut, groups).filter(F.col("_b") <= F.col("_cb"))
    if rank_col:
        o = offs.join(F.broadcast(cut.df.select(*groups, "_cb")) if cut.fits else cut.df.select(*groups, "_cb"),
                      groups).filter(F.col("_b") <= F.col("_cb")).select(*groups, "_b", F.col("_before").alias("_o"))
        ranked = sel.join(o, [*groups, "_b"]).withColumn(rank_col, (F.col("_o") + _rank(groups, id_col)).cast("bigint"))
        return ranked.filter(F.col(rank_col) <= F.col("_k")).drop(*_HELPERS, "_o")
    whole = sel.filter(F.col("_b") < F.col("_cb"))
    straddle = (sel.filter(F.col("_b") == F.col("_cb"))
                .withColumn("_in", F.col("_before") + _rank(groups, id_col) <= F.col("_k"))
                .filter(F.col("_in")).drop("_in"))
    return whole.unionByName(straddle).drop(*_HELPERS)


def mark_ranked(df: DataFrame, groups: Sequence[str], quota: Dim, seed,
                id_col: str = "id", salt: Sequence = (), k_col: str = "k", flag_col: str = "_in",
                digits: int = BUCKET_DIGITS) -> DataFrame:
    """Every row, with ``flag_col`` = (rank <= k). Only the straddling bucket is ranked."""
    groups = list(groups)
    d = with_order_key(df, seed, id_col, salt, digits)
    cut, _ = _cut(d, groups, quota, k_col)
    m = join_dim(d, cut, groups, "left")
    status = (F.when(F.col("_cb").isNull(), F.lit(False))
              .when(F.col("_b") < F.col("_cb"), F.lit(True))
              .when(F.col("_b") > F.col("_cb"), F.lit(False)))
    decided = m.withColumn(flag_col, status).filter(F.col(flag_col).isNotNull())
    straddle = (m.filter(F.col("_b") == F.col("_cb"))
                .withColumn(flag_col, F.col("_before") + _rank(groups, id_col) <= F.col("_k")))
    return decided.unionByName(straddle).drop(*_HELPERS)
