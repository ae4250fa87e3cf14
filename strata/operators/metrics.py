"""Confusion counts and the scores derived from them.

The confusion table has at most C^2 rows whatever the data size; everything
after it works on that table and on the C-row class list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def classes(spark: SparkSession, num_classes: int) -> DataFrame:
    return spark.range(num_classes).select(F.col("id").cast("int").alias("class_id"))


def confusion(df: DataFrame, num_classes: int, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """(label, pred, n); pairs outside 0..C-1 are ignored."""
    ok = F.col(label_col).between(0, num_classes - 1) & F.col(pred_col).between(0, num_classes - 1)
    return (df.filter(ok).groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def _ratio(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")), F.lit(0.0))


def cells(df: DataFrame, by: list[str] = (), label_col: str = "label", pred_col: str = "pred", loss_col: str | None = "loss") -> DataFrame:
    """One aggregate per (group, label, pred): rows, sum of losses and rows with a loss. At most C^2
    rows per group; every score below is made from it, so the input is scanned once."""
    loss = F.col(loss_col).cast("double") if loss_col else F.lit(None).cast("double")
    return df.groupBy(*by, F.col(label_col).alias("label"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss_sum"), F.count(loss).alias("loss_n"))


def _parts(table: DataFrame, num_classes: int, by: list[str]) -> DataFrame:
    """(by.., class_id, num_true, num_pred, tp, loss_sum, loss_n): each cell gives its label and its
    prediction a part, and the row class_id = -1 the losses; dense over the classes."""
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    ok = F.col("label").between(0, num_classes - 1) & F.col("pred").between(0, num_classes - 1)
    n, hit = F.when(ok, F.col("n")).otherwise(zero), F.when(ok & (F.col("label") == F.col("pred")), F.col("n")).otherwise(zero)
    has_loss = "loss_sum" in table.columns
    loss = (F.coalesce("loss_sum", none), F.col("loss_n")) if has_loss else (none, zero)
    part = lambda cls, t, p, tp, ls, ln: F.struct(
        cls.cast("int").alias("class_id"), t.alias("num_true"), p.alias("num_pred"), tp.alias("tp"), ls.alias("loss_sum"), ln.alias("loss_n"))
    inside = lambda c: F.when(ok, F.col(c)).otherwise(F.lit(-1))
    exploded = table.select(*by, F.explode(F.array(
        part(inside("label"), n, zero, hit, none, zero), part(inside("pred"), zero, n, zero, none, zero),
        part(F.lit(-1), zero, zero, zero, *loss))).alias("x")).select(*by, "x.*")
    sums = [F.sum(c).alias(c) for c in ("num_true", "num_pred", "tp", "loss_sum", "loss_n")]
    got = exploded.groupBy(*by, "class_id").agg(*sums)
    if not by:
        return classes(table.sparkSession, num_classes + 1).select((F.col("class_id") - 1).alias("class_id")).join(got, "class_id", "left").fillna(0)
    # Dense over the classes of each group: one row per group is exploded, and summed with the parts.
    every = got.filter("class_id = -1").select(*by, F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))).alias("class_id"))
    fill = every.select(*by, "class_id", *[zero.alias(c) for c in ("num_true", "num_pred", "tp")], none.alias("loss_sum"), zero.alias("loss_n"))
    return got.unionByName(fill).groupBy(*by, "class_id").agg(*sums)


def _scored(parts: DataFrame) -> DataFrame:
    t = parts.withColumn("precision", _ratio(F.col("tp"), F.col("num_pred"))).withColumn("recall", _ratio(F.col("tp"), F.col("num_true")))
    return t.withColumn("f1score", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


_SCORES = ("class_id", "precision", "recall", "f1score", "num_true", "num_pred", "tp")


def class_scores(conf: DataFrame, num_classes: int) -> DataFrame:
    """Per-class precision, recall and F1 over all C classes; 0 where undefined."""
    return _scored(_parts(conf, num_classes, []).filter("class_id >= 0")).select(*_SCORES)


def _macro(parts: DataFrame, by: list[str], with_loss: bool) -> DataFrame:
    cls = F.col("class_id") >= 0
    out = [F.avg(F.when(cls, F.col(c))).alias(a) for c, a in (("precision", "macro_pc"), ("recall", "macro_rc"), ("f1score", "macro_f1"))]
    out.append(F.try_divide(F.sum(F.when(cls, F.col("tp"))), F.sum(F.when(cls, F.col("num_true")))).alias("acc"))
    if with_loss:
        out.append(F.try_divide(F.sum("loss_sum"), F.sum("loss_n")).alias("loss"))
    return _scored(parts).groupBy(*by).agg(*out)


def summary(table: DataFrame, num_classes: int) -> DataFrame:
    """Accuracy, macro precision / recall / F1 (plain means over all C classes), and the
    mean loss where ``table`` comes from ``cells`` rather than ``confusion``."""
    return _macro(_parts(table, num_classes, []), [], "loss_sum" in table.columns)


# --- grouped evaluation (one evaluation per run / epoch / part) -----------------

def class_scores_by(table: DataFrame, num_classes: int, by: list[str]) -> DataFrame:
    """Per group and class: precision, recall, F1 over the dense class list."""
    return _scored(_parts(table, num_classes, by).filter("class_id >= 0")).select(*by, *_SCORES)


def summary_by(df: DataFrame, num_classes: int, by: list[str], loss_col: str = "loss") -> DataFrame:
    """Per group: loss (mean), acc, macro_pc, macro_rc, macro_f1."""
    return _macro(_parts(cells(df, by, loss_col=loss_col), num_classes, by), by, True)
