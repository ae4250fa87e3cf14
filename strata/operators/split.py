"""H1: stratified train/test split by class size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.operators.dims import Dim, checked, derive
from strata.operators.ranking import digits_for, mark_ranked

# Fixed values of the split rule: (size bound, test rows) for small classes and
# the line int(8/90 * n + 10/9) for classes of 11 to 99 rows.
SLOPE = 8 / 90
INTERCEPT = 10 / 9


def test_quota(n: Column, ratio: float) -> Column:
    """Test rows for a class of ``n`` rows: <3 -> 0, 3-5 -> 1, 6-10 -> 2,
    11-99 -> int(8/90 n + 10/9), >=100 -> int(n * ratio); never more than n."""
    k = (F.when(n < 3, F.lit(0))
         .when(n <= 5, F.lit(1))
         .when(n <= 10, F.lit(2))
         .when(n < 100, F.floor(F.lit(SLOPE) * n + F.lit(INTERCEPT)))
         .otherwise(F.floor(n * F.lit(float(ratio)))))
    return F.least(k.cast("bigint"), n.cast("bigint"))


def class_sizes(df: DataFrame, label_col: str = "label") -> Dim:
    return checked(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")))


def split_ratio(classes: Dim, num_test: int) -> float:
    total = classes.df.agg(F.sum("n")).first()[0] or 0
    return num_test / total if total else 0.0


def stratified_split(df: DataFrame, test_ratio: float | None = None, num_test: int | None = None,
                     seed=42, label_col: str = "label", id_col: str = "id",
                     classes: Dim | None = None, part_col: str = "part") -> DataFrame:
    """Adds ``part`` ('train'/'test'): per class, the first k rows of the seeded order are test."""
    classes = classes or class_sizes(df, label_col)
    if test_ratio is None:
        if num_test is None:
            raise ValueError("give test_ratio or num_test")
        test_ratio = split_ratio(classes, num_test)
    quota = derive(classes, classes.df.select(label_col, test_quota(F.col("n"), test_ratio).alias("k")))
    marked = mark_ranked(df, [label_col], quota, seed, id_col=id_col, digits=digits_for(classes))
    return (marked.withColumn(part_col, F.when(F.col("_in"), "test").otherwise("train"))
            .drop("_in"))
