"""H6-H8: bagging with per-class quotas, and the out-of-bag rows.

Quotas are computed on the class table (C rows per bag), never on the rows.
Rows are then cut per (bag, label) with the histogram cut of ``ranking``;
each bag has its own order ``md5(seed:bag:id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.hashing import draw
from strata.operators.dims import Dim, checked, derive, join_dim
from strata.operators.ranking import digits_for, rank_within, take_ranked

#: Halvings after which no class lacks a row (class sizes are below 2^HALVINGS).
HALVINGS = 60
# Fixed values of the reference's trim rule: start at 1000, lower by 100.
CUT_START = 1000
CUT_STEP = 100


def class_sizes(df: DataFrame, label_col: str = "label") -> Dim:
    return checked(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")))


def _total(sizes: Dim) -> int:
    return int(sizes.df.agg(F.sum("n")).first()[0] or 0)


def _bags(sizes: Dim, bags: int) -> DataFrame:
    return sizes.df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))


def quotas_same(sizes: Dim, bags: int, total: int, min_cat: int = 2, label_col: str = "label") -> Dim:
    """H6 quotas: n if n <= min_cat else int(e*n + min_cat - min_cat*e), e = total / N."""
    big_n = _total(sizes)
    e = total / big_n if big_n else float("inf")
    if e > 1:
        raise ValueError(f"total {total} is larger than the {big_n} rows available")
    b = min_cat - min_cat * e
    n = F.col("n")
    k = F.when(n <= min_cat, n).otherwise(F.floor(F.lit(e) * n + F.lit(b))).cast("bigint")
    return derive(sizes, _bags(sizes, bags).select("bag", label_col, k.alias("k")), bags)


def quotas_random(sizes: Dim, bags: int, total: int, min_cat: int = 2, seed=42,
                  label_col: str = "label") -> Dim:
    """H7 quotas, exactly ``total`` per bag.

    1. q0 uniform in [min(min_cat, n), n] from a hashed draw. Where a bag's quotas do not reach
       ``total``, what each class lacks to n is halved (rounding down) as often as the sum
       needs; no draw is repeated or given up.
    2. cut = the largest of 1000, 900, ..., 0 with sum(q0 < cut) <= total.
    3. Classes under the cut keep q0; the others share the rest in proportion
       to q0 (floor, then +1 by largest remainder, lowest label first).
    """
    if _total(sizes) < total:
        raise ValueError(f"total {total} is larger than the {_total(sizes)} rows available")
    n = F.col("n")
    lo = F.least(F.lit(min_cat).cast("bigint"), n)
    drawn = _bags(sizes, bags).withColumn("_lack", n - lo - F.pmod(draw(seed, F.col("bag"), F.col(label_col)), n - lo + 1))
    tried = drawn.withColumn("halved", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))))
    needed = (tried.groupBy("bag", "halved").agg(F.sum(n - F.expr("shiftright(_lack, halved)")).alias("s"))
              .filter(F.col("s") >= total).groupBy("bag").agg(F.min("halved").alias("halved")))
    q = drawn.join(needed, "bag").select("bag", label_col, (n - F.expr("shiftright(_lack, halved)")).alias("q0"))
    cuts = F.array(*[F.lit(c) for c in range(CUT_START, -1, -CUT_STEP)])
    cut = (q.withColumn("c", F.explode(cuts))
           .groupBy("bag", "c").agg(F.sum(F.when(F.col("q0") < F.col("c"), F.col("q0")).otherwise(0)).alias("sc"))
           .filter(F.col("sc") <= total).groupBy("bag").agg(F.max("c").alias("cut")))
    q = q.join(cut, "bag").withColumn("big", F.col("q0") >= F.col("cut"))
    per_bag = Window.partitionBy("bag")
    q = (q.withColumn("s_big", F.sum(F.when(F.col("big"), F.col("q0")).otherwise(0)).over(per_bag))
         .withColumn("rest", F.lit(total) - F.sum(F.when(~F.col("big"), F.col("q0")).otherwise(0)).over(per_bag)))
    # Products of two row counts pass 2^63: exact integers of 38 digits.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    share, whole = (wide("rest") * wide("q0")).cast("decimal(38,0)"), wide("s_big").cast("decimal(38,0)")
    used = F.col("big") & (F.col("s_big") > 0)
    q = (q.withColumn("_share", share).withColumn("_whole", whole)
         .withColumn("base", F.when(used, F.expr("_share div _whole")).otherwise(0).cast("bigint"))
         .withColumn("rem", F.when(used, F.col("_share") % F.col("_whole")).otherwise(-1).cast("bigint")))
    q = q.withColumn("left", F.col("rest") - F.sum(F.when(F.col("big"), F.col("base")).otherwise(0)).over(per_bag))
    order = Window.partitionBy("bag").orderBy(F.col("big").desc(), F.col("rem").desc(), F.col(label_col))
    q = q.withColumn("extra", F.when(F.col("big") & (F.row_number().over(order) <= F.col("left")), 1).otherwise(0))
    k = F.when(F.col("big"), F.col("base") + F.col("extra")).otherwise(F.col("q0")).cast("bigint")
    return derive(sizes, q.select("bag", label_col, k.alias("k")), bags)


def take_bags(df: DataFrame, quota: Dim, bags: int, seed=42, label_col: str = "label",
              id_col: str = "id", digits: int | None = None) -> DataFrame:
    """Rows of every bag: per (bag, label) the first k rows of md5(seed:bag:id)."""
    expanded = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    kw = {"digits": digits} if digits else {}
    return take_ranked(expanded, ["bag", label_col], quota, seed, id_col=id_col,
                       salt=("bag",), rank_col=None, **kw)


#: Slots made by one row of the slot table at most.
SLOT_CHUNK = 1_000_000


def slot_rows(df: DataFrame, count: Column, keys: list[str]) -> DataFrame:
    """Each row repeated ``count`` times with ``slot`` = 0 .. count-1. Large counts become chunk
    rows first, which are dealt out, so that no row makes more than SLOT_CHUNK slots."""
    chunk = F.col("_chunk")
    chunks = (df.withColumn("_count", count.cast("bigint")).filter("_count > 0")
              .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_count - 1) div {SLOT_CHUNK}")))))
    last = F.least(F.col("_count"), (chunk + 1) * SLOT_CHUNK) - 1
    return (chunks.repartition(*keys, "_chunk").withColumn("slot", F.explode(F.sequence(chunk * SLOT_CHUNK, last)))
            .drop("_count", "_chunk"))


def draw_bags(df: DataFrame, quota: Dim, sizes: Dim, seed=42, label_col: str = "label",
              id_col: str = "id") -> DataFrame:
    """Bags with replacement: slot s of (bag, label) takes the row of rank
    1 + H(seed:bag:label:s) mod n. Ranks come from one bucketed ranking, and the
    join on (label, rank) spreads a hot class's draws over many keys."""
    ranked = rank_within(df, [label_col], seed, id_col=id_col, rank_col="_rank", digits=digits_for(sizes))
    slots = (join_dim(quota.df.filter(F.col("k") > 0), Dim(sizes.df.select(label_col, "n"), sizes.rows, sizes.max_rows), label_col)
             .select("bag", label_col, "n", "k"))
    slots = slot_rows(slots, F.col("k"), ["bag", label_col]).drop("k")
    slots = slots.withColumn("_rank", F.pmod(draw(seed, F.col("bag"), F.col(label_col), F.col("slot")), F.col("n")) + 1)
    return slots.join(ranked, [label_col, "_rank"]).drop("_rank", "n")


def bootstrap(df: DataFrame, bags: int, total: int, dist: str = "same", min_cat: int = 2, seed=42,
              label_col: str = "label", id_col: str = "id", sizes: Dim | None = None,
              replace: bool = False) -> DataFrame:
    """B bags of about ``total`` rows per class quota; without replacement (as
    the reference) unless ``replace``."""
    sizes = sizes or class_sizes(df, label_col)
    if dist == "same":
        quota = quotas_same(sizes, bags, total, min_cat, label_col)
    elif dist == "random":
        quota = quotas_random(sizes, bags, total, min_cat, seed, label_col)
    else:
        raise ValueError(f"unknown dist {dist!r}; expected 'same' or 'random'")
    if replace:
        return draw_bags(df, quota, sizes, seed, label_col, id_col)
    return take_bags(df, quota, bags, seed, label_col, id_col, digits=digits_for(sizes))


def out_of_bag(df: DataFrame, bagged: DataFrame, id_col: str = "id") -> DataFrame:
    """H8: rows whose id is in no bag."""
    return df.join(bagged.select(id_col).distinct(), id_col, "left_anti")


def write_bags(bagged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the bags partitioned by ``bag``, so each member's trainer reads
    only its own folder (partition pruning on ``bag = b``)."""
    bagged.write.mode(mode).partitionBy("bag").parquet(path)
