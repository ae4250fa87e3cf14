"""The validation pass: scores -> predictions -> loss -> confusion -> scores.

``evaluate`` takes rows with a score vector and a label (and optional grouping
columns such as run, epoch, part) and returns the per-group summary and the
per-class scores, each from one partial aggregate over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strata.functions.arrays import argmax
from strata.operators import losses as LS
from strata.operators import metrics as M


@dataclass
class Evaluation:
    summary: DataFrame   # by..., loss, acc, macro_pc, macro_rc, macro_f1
    classes: DataFrame   # by..., class_id, precision, recall, f1score, num_true, num_pred, tp


def evaluate(df: DataFrame, num_classes: int, by: Sequence[str] = (), loss: str = "CE",
             z_col: str = "z", label_col: str = "label", **loss_args) -> Evaluation:
    by = list(by)
    rows = df.withColumn("pred", argmax(z_col))
    if loss == "ICE":
        rows = LS.ice_row_loss(rows, num_classes, z_col=z_col, label_col=label_col, **loss_args)
    else:
        rows = LS.row_loss(rows, loss, z_col=z_col, label_col=label_col, **loss_args)
    table = M.cells(rows, by, label_col)
    if by:
        return Evaluation(M.summary_by(rows.withColumnRenamed(label_col, "label"), num_classes, by), M.class_scores_by(table, num_classes, by))
    return Evaluation(M.summary(table, num_classes), M.class_scores(table, num_classes))
