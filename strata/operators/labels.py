"""Class codes and dense label ids.

Ids are ranked over the *distinct* codes only (a table with one row per class),
never over the rows; the class table is size-checked and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions.text import class_code, pad_code
from strata.operators.dims import Dim, checked, join_dim

LEVELS = ("S", "M", "L")


def level_code(level: str = "S"):
    """The code a target level keys on. S: full code; M: medium code; L: large code."""
    if level == "S":
        return class_code()
    if level == "M":
        return pad_code("digit_2", 2)
    if level == "L":
        return F.coalesce(F.col("digit_1").cast("string"), F.lit(""))
    raise ValueError(f"unknown level {level!r}; expected one of {LEVELS}")


def with_codes(df: DataFrame) -> DataFrame:
    """Zero-pad the code columns and add the full class code ``digit``."""
    return df.withColumns({
        "digit": class_code(),
        "digit_2": pad_code("digit_2", 2),
        "digit_3": pad_code("digit_3", 3),
    })


def class_table(df: DataFrame, code_col: str = "digit") -> Dim:
    """(label, digit, n): one row per distinct code, ids in code-point order."""
    counts = df.groupBy(F.col(code_col).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("label", (F.row_number().over(Window.orderBy("digit")) - 1).cast("int"))
    return checked(ranked.select("label", "digit", "n"))


def label_map(df: DataFrame, level: str = "S") -> DataFrame:
    """(label, digit) over the sorted distinct codes of ``level``."""
    return class_table(df.select(level_code(level).alias("digit"))).df.select("label", "digit")


def encode(df: DataFrame, level: str = "S") -> tuple[DataFrame, Dim]:
    """Attach ``digit`` (the level's code) and its dense ``label``; also
    return the checked class table (label, digit, n) for later size-bounded joins."""
    coded = df.withColumn("digit", level_code(level))
    classes = class_table(coded)
    out = join_dim(coded, Dim(classes.df.select("digit", "label"), classes.rows, classes.max_rows), "digit")
    return out, classes


def label_encode(df: DataFrame, level: str = "S") -> DataFrame:
    return encode(df, level)[0]


def label_levels(df: DataFrame) -> DataFrame:
    """D3: label ids at all three levels side by side (id, label_s, label_m, label_l)."""
    out = df.select("id", *[level_code(lv).alias(f"code_{lv.lower()}") for lv in LEVELS])
    for lv in LEVELS:
        c = f"code_{lv.lower()}"
        dim = class_table(out, c)
        out = join_dim(out, Dim(dim.df.select(F.col("digit").alias(c), F.col("label").alias(f"label_{lv.lower()}")),
                                dim.rows, dim.max_rows), c)
    return out.select("id", "label_s", "label_m", "label_l")


def class_rollup(df: DataFrame) -> DataFrame:
    """Row counts at every level of the code hierarchy (large, medium, small, total)."""
    coded = with_codes(df)
    return (coded.rollup("digit_1", "digit_2", "digit_3")
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts(df: DataFrame, part_col: str = "part") -> DataFrame:
    """Rows per label for train and test side by side."""
    p = F.col(part_col)
    return df.groupBy("label").agg(
        F.sum(F.when(p == "train", 1).otherwise(0)).cast("bigint").alias("n_train"),
        F.sum(F.when(p == "test", 1).otherwise(0)).cast("bigint").alias("n_test"),
    )
