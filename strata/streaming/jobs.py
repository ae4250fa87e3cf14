"""Structured Streaming forms of the batch operators.

Each job reads a parquet folder as a stream, runs the same column functions as
its batch twin, and writes to a sink with a checkpoint of its own. ``run`` drives
a query over the input there is with ``Trigger.AvailableNow`` and returns the sink
as a batch DataFrame; given the same sink and checkpoint again it resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.arrays import argmax
from strata.functions.text import TEXT_COLS, clean_columns, join_texts
from strata.operators.dims import Dim, join_dim
from strata.operators.labels import level_code
from strata.session import drop_table, scratch_path
from strata.sources.corpus import corpus, logits


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder as a stream; a single file is read as its folder
    filtered to that file name (the file source watches folders)."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    # Asked of the path's own file system, which need not be the driver's disk.
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return r.parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole tables under ``path``, by the number of the batch that wrote them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [f.getPath() for f in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(f.getName().removeprefix("version-")) for f in done if f.getName().startswith("version-"))


def _version_to(path: str):
    """Each batch's table gets a folder of its own; the one before it stays, so a crash at any
    point leaves a whole table."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/version-{epoch}")
        for old in _versions(spark, path):
            if old < epoch - 1:
                drop_table(spark, f"{path}/version-{old}")
    return write


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sink of ``run``: the newest whole table, or all that was appended."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/version-{versions[-1]}" if versions else path)


def run(stream: DataFrame, name: str, output_mode: str = "append", sink: str | None = None,
        checkpoint: str | None = None) -> DataFrame:
    """Run over what is there now (AvailableNow) into a parquet sink; return the sink. Called again
    with the same ``sink`` and ``checkpoint`` it goes on where it stopped; without them both are fresh."""
    spark = stream.sparkSession
    if (sink is None) != (checkpoint is None):
        raise ValueError("sink and checkpoint go together")
    out = sink or scratch_path(spark, f"{name}-out")
    w = stream.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True)
    if output_mode == "complete":
        # A complete-mode result is the whole table each batch.
        q = w.outputMode("complete").foreachBatch(_version_to(out)).start()
    else:
        q = w.outputMode(output_mode).format("parquet").option("path", out).start()
    q.awaitTermination()
    return read_sink(spark, out)


def confusion_stream(scored: DataFrame, num_classes: int, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Running confusion counts (state: one count per (label, pred) pair)."""
    ok = F.col(label_col).between(0, num_classes - 1) & F.col(pred_col).between(0, num_classes - 1)
    return (scored.filter(ok).groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def argmax_stream(embeddings: DataFrame, num_classes: int, member: int = 0, scale: float = 10.0) -> DataFrame:
    return logits(embeddings, member, num_classes, scale).select("id", "label", argmax("z").alias("pred"))


def label_stream(documents: DataFrame, label_map: Dim, level: str = "S") -> DataFrame:
    """Stateless clean + code + label (stream-static join to the label map)."""
    c = clean_columns(corpus(documents))
    coded = c.withColumn("digit", level_code(level)).withColumn("text", join_texts(TEXT_COLS))
    return join_dim(coded, label_map, "digit").select("id", "digit", "label", "text")


def dedup_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of every key, whatever the order and the files it comes in. The state is one
    entry per distinct key, as in the batch operator; it has no watermark, since a bound on lateness
    would let a key in again or drop a late one."""
    return events.dropDuplicates(keys)
