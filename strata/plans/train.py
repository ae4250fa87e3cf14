"""The training loop as Spark jobs: per epoch, continue the focal-loss head from
its weights, evaluate train and valid, append the epoch to the run table, and
stop once the valid loss has not improved for ``patience`` epochs.

Only model parameters (C x D) and one summary row per epoch reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from strata.operators import runs as RN
from strata.operators.training import FocalModel, train_focal
from strata.plans.evaluate import evaluate
from strata.session import scratch_path


@dataclass
class Run:
    summary: DataFrame      # run_id, epoch, train_* and valid_* metrics (the run table)
    best: FocalModel        # weights of the epoch with the lowest valid loss
    best_epoch: int
    stopped_at: int | None  # epoch at which patience ran out, if it did


def _evaluate(model: FocalModel, both: DataFrame, num_classes: int, x_col: str, label_col: str,
              run_id: str, epoch: int) -> DataFrame:
    """One pass over train and valid rows (tagged by ``part``)."""
    scored = both.select(F.lit(run_id).alias("run_id"), F.lit(epoch).alias("epoch"), "part",
                         F.col(label_col).alias("label"), model.scores(x_col).alias("z"))
    return evaluate(scored, num_classes, by=["run_id", "epoch", "part"], loss="FCE").summary


def train_run(train: DataFrame, valid: DataFrame, num_classes: int, dims: int, epochs: int = 10,
              steps_per_epoch: int = 3, patience: int = 10, lr: float = 2.0, run_id: str = "run",
              x_col: str = "embedding", label_col: str = "label", path: str | None = None) -> Run:
    spark = train.sparkSession
    path = path or scratch_path(spark, "run")
    cols = [x_col, label_col]
    # Read every epoch: kept for the whole loop (recomputed if an executor is lost).
    train_rows = train.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    both = (train.select(*cols).withColumn("part", F.lit("train"))
            .unionByName(valid.select(*cols).withColumn("part", F.lit("valid")))
            .persist(StorageLevel.MEMORY_AND_DISK))
    model, best, best_epoch, stopped = None, None, -1, None
    for epoch in range(epochs):
        model = train_focal(train_rows, num_classes, dims, steps=steps_per_epoch, lr=lr, x_col=x_col,
                            label_col=label_col, init=model, cache=False)
        per_part = _evaluate(model, both, num_classes, x_col, label_col, run_id, epoch)
        RN.append_summary(RN.summary_rows(per_part), path)
        row = RN.early_stop(RN.read_summary(spark, path).filter(F.col("run_id") == run_id), patience) \
            .filter(F.col("epoch") == epoch).first()
        if row["improved"] == 1:
            best, best_epoch = model, epoch
        if row["stop"] == 1:
            stopped = epoch
            break
    train_rows.unpersist()
    both.unpersist()
    return Run(RN.read_summary(spark, path).filter(F.col("run_id") == run_id), best, best_epoch, stopped)
