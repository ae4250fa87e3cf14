"""Class weights and the three losses, per row in array form.

Each row's loss is an expression over its own score vector, so a loss is one
projection plus one partial aggregate. Per-class weights are a C-row table
joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.arrays import at, softmax
from strata.operators.dims import Dim, checked, derive, join_dim

# Fixed values of the reference's losses.
EPS = 1e-9
FOCAL_ALPHA = 1.0
FOCAL_GAMMA = 2.0
ICE_SCALE = 225.0
REDUCTIONS = ("mean", "sum", "none")


def class_weights(df: DataFrame, label_col: str = "label", power: float = 1.0,
                  num_classes: int | None = None) -> Dim:
    """w = 1/n^power, normalized to sum to C (C = classes present unless given)."""
    counts = checked(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")))
    raw = F.lit(1.0) / F.pow(F.col("n").cast("double"), F.lit(float(power)))
    every = Window.partitionBy()
    c = F.lit(float(num_classes)) if num_classes else F.count(F.lit(1)).over(every).cast("double")
    w = counts.df.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.sum("_w").over(every) * c)
    return derive(counts, w.select(label_col, "weight"))


def _weight_of(df: DataFrame, weights: Dim | None, ignore_index: int | None, label_col: str) -> tuple[DataFrame, Column]:
    w = F.lit(1.0)
    if weights is not None:
        df = join_dim(df, weights, label_col, "left")
        w = F.coalesce(F.col("weight"), F.lit(0.0))
    if ignore_index is not None:
        w = F.when(F.col(label_col) == ignore_index, F.lit(0.0)).otherwise(w)
    return df, w


def p_true(z_col: str = "z", label_col: str = "label", softmax_first: bool = True) -> Column:
    """The true class's probability; ``softmax_first=False`` where z_col holds probabilities already."""
    return at(softmax(z_col) if softmax_first else z_col, F.col(label_col))


def ce_term(p: Column) -> Column:
    return -F.log(p + F.lit(EPS))


def focal_term(p: Column, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    return -(F.pow(F.lit(1.0) - p, F.lit(float(gamma))) * F.lit(float(alpha)) * F.log(p + F.lit(EPS)))


def row_loss(df: DataFrame, kind: str = "CE", z_col: str = "z", label_col: str = "label",
             weights: Dim | None = None, ignore_index: int | None = None,
             alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, out: str = "loss",
             softmax_first: bool = True) -> DataFrame:
    """Per-row CE or focal loss (reduction 'none')."""
    df, w = _weight_of(df, weights, ignore_index, label_col)
    p = p_true(z_col, label_col, softmax_first)
    if kind == "CE":
        term = ce_term(p)
    elif kind == "FCE":
        term = focal_term(p, alpha, gamma)
    else:
        raise ValueError(f"unknown loss {kind!r}; row_loss takes CE or FCE (ICE needs batches)")
    return df.withColumn(out, w * term).drop("weight")


def ice_row_loss(df: DataFrame, num_classes: int, batch_col: str = "batch_id", z_col: str = "z",
                 label_col: str = "label", power: float = 1.0, scale: float = ICE_SCALE,
                 out: str = "loss", present_only: bool = False, weights: Dim | None = None,
                 ignore_index: int | None = None, softmax_first: bool = True) -> DataFrame:
    """Weights from the current batch's label counts, 1/(cnt^power + eps),
    normalized to ``scale``; a class absent from the batch counts 0 (raw 1/eps),
    which leaves the present classes almost no weight (as the reference does).
    ``present_only`` normalizes over the classes present in the batch instead.
    ``weights`` and ``ignore_index`` act as in ``row_loss``. The score vector becomes one number
    before the only shuffle, which brings a batch's rows together."""
    df, own = _weight_of(df, weights, ignore_index, label_col)
    df = df.withColumn("_term", own * ce_term(p_true(z_col, label_col, softmax_first))).drop("weight", z_col)
    batch = Window.partitionBy(batch_col)
    df = df.withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(batch_col, label_col)))
    df = df.withColumn("_inv", F.lit(1.0) / (F.pow(F.col("_cnt").cast("double"), F.lit(float(power))) + F.lit(EPS)))
    # A class's rows share its one term, so sums over rows are sums over the classes present.
    present = F.round(F.sum(F.lit(1.0) / F.col("_cnt")).over(batch))
    absent = F.lit(0.0) if present_only else (F.lit(num_classes) - present) / F.lit(EPS)
    norm = F.sum(F.col("_inv") / F.col("_cnt")).over(batch) + absent
    w = F.col("_inv") / norm * F.lit(float(scale))
    return df.withColumn(out, w * F.col("_term")).drop("_term", "_cnt", "_inv")


def reduce(df: DataFrame, reduction: str = "mean", col: str = "loss") -> DataFrame:
    if reduction == "mean":
        return df.agg(F.avg(col).alias(col))
    if reduction == "sum":
        return df.agg(F.sum(col).alias(col))
    if reduction == "none":
        return df
    raise ValueError(f"unexpected reduction {reduction!r}")


def get_loss(kind: str, **kwargs):
    """Loss by name -> a function DataFrame -> DataFrame with a ``loss`` column."""
    if kind in ("CE", "FCE"):
        return lambda df: row_loss(df, kind=kind, **kwargs)
    if kind == "ICE":
        return lambda df: ice_row_loss(df, **kwargs)
    raise ValueError(f"unknown loss {kind!r}; expected CE, FCE or ICE")
