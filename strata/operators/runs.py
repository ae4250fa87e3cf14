"""Run records, their history and model selection.

A run table holds one row per (run_id, epoch) with train and valid metrics;
every operator here works on it or on the per-class history, both tiny
(epochs x classes), with windows partitioned by run.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions.hashing import draw

METRICS = ("loss", "acc", "pc", "rc", "f1")
SUMMARY_COLS = tuple(f"{p}_{m}" for p in ("train", "valid") for m in METRICS)


def summary_rows(per_part: DataFrame) -> DataFrame:
    """(run_id, epoch, part, loss, acc, macro_pc, macro_rc, macro_f1) -> one row per
    epoch with the reference's 10 columns (train_loss ... valid_f1)."""
    renamed = per_part.select("run_id", "epoch", "part", "loss", "acc", F.col("macro_pc").alias("pc"),
                              F.col("macro_rc").alias("rc"), F.col("macro_f1").alias("f1"))
    aggs = [F.first(F.when(F.col("part") == p, F.col(m)), ignorenulls=True).alias(f"{p}_{m}")
            for p in ("train", "valid") for m in METRICS]
    return renamed.groupBy("run_id", "epoch").agg(*aggs)


def append_rows(rows: DataFrame, path: str, keys: tuple[str, ...] = ("run_id", "epoch")) -> None:
    """Append rows to a table, replacing the rows of the same keys: a rerun leaves each key once.

    Rows are written under a name of their own first; what makes them part of the table is the commit
    written after them, one row per key. A job that dies in between leaves files that no commit names.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    rows.withColumn("_part", F.lit(name)).write.parquet(f"{path}/rows/{name}")
    written = spark.read.parquet(f"{path}/rows/{name}").select(*keys, "_part").distinct()
    written.withColumn("_at", F.lit(time.time_ns())).coalesce(1).write.parquet(f"{path}/commits/{name}")


def read_rows(spark, path: str, keys: tuple[str, ...] = ("run_id", "epoch")) -> DataFrame:
    """The rows that the last commit of each key names."""
    reader = spark.read.option("recursiveFileLookup", True)
    last = reader.parquet(f"{path}/commits").groupBy(*keys).agg(F.max(F.struct("_at", "_part")).alias("_last")).select(*keys, "_last._part")
    return reader.parquet(f"{path}/rows").join(last, [*keys, "_part"]).drop("_part")


def append_summary(rows: DataFrame, path: str) -> None:
    """A5: append epochs to the run table; a rerun of an epoch replaces it."""
    append_rows(rows, path)


def read_summary(spark, path: str) -> DataFrame:
    """Read the run table back."""
    return read_rows(spark, path)


def best_epoch(summary: DataFrame) -> DataFrame:
    """per run, the first epoch with the lowest valid loss and the first
    with the highest valid accuracy."""
    return summary.groupBy("run_id").agg(
        F.min_by("epoch", F.struct(F.col("valid_loss"), F.col("epoch"))).alias("best_loss_epoch"),
        F.min_by("epoch", F.struct(-F.col("valid_acc"), F.col("epoch"))).alias("best_acc_epoch"))


def early_stop(summary: DataFrame, patience: int) -> DataFrame:
    """improved = valid loss below every earlier one; patience = epochs since
    the last improvement; stop = the first epoch where patience reaches the limit."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = summary.select("run_id", "epoch", "valid_loss")
    t = t.withColumn("improved", (F.col("valid_loss") < F.coalesce(F.min("valid_loss").over(before), F.lit(math.inf))).cast("int"))
    t = t.withColumn("patience", (F.col("epoch") - F.max(F.when(F.col("improved") == 1, F.col("epoch"))).over(upto)).cast("int"))
    first_stop = F.min(F.when(F.col("patience") >= patience, F.col("epoch"))).over(Window.partitionBy("run_id"))
    return t.withColumn("stop", F.coalesce((F.col("epoch") == first_stop).cast("int"), F.lit(0))).drop("valid_loss")


def class_history(scores: DataFrame) -> DataFrame:
    """Per-class scores of every epoch as a long table
    (run_id, part, metric, class_id, epoch, value)."""
    long = scores.select("run_id", "part", "class_id", "epoch",
                         F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                             for m in ("precision", "recall", "f1score")])).alias("_m"))
    return long.select("run_id", "part", F.col("_m.metric").alias("metric"), "class_id", "epoch", F.col("_m.value").alias("value"))


def history_wide(history: DataFrame, epochs: list[int]) -> DataFrame:
    """One column per epoch (``epoch_<e>``), explicit epoch list."""
    wide = history.groupBy("run_id", "part", "metric", "class_id").pivot("epoch", epochs).agg(F.first("value"))
    return wide.select("run_id", "part", "metric", "class_id", *[F.col(str(e)).alias(f"epoch_{e}") for e in epochs])


def write_configs(configs: DataFrame, base_path: str) -> None:
    """A8 (write side): one config record per run, in a folder per run."""
    configs.write.mode("overwrite").partitionBy("run_id").json(base_path)


def batches(df: DataFrame, n_rows: int, batch_size: int = 16, seed=42, id_col: str = "id") -> DataFrame:
    """batch ids of about ``batch_size`` rows from a hash, no global sort."""
    nb = max(1, math.ceil(n_rows / batch_size))
    return df.withColumn("batch_id", F.pmod(draw(seed, F.col(id_col)), F.lit(nb)).cast("bigint"))

