"""Session and shared-storage helpers.

The library never picks a machine-local folder on a cluster: scratch output
(lineage cuts, round trips, stream sinks) goes under the folder the cluster
names in ``spark.checkpoint.dir``. Only a local master (tests, one machine) gets
a temporary folder when that is unset; any other master raises.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "strata") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # MS949 (Python's cp949) is only reachable with the legacy charset switch.
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once a context), so that Python workers import it wherever the
    job was started and whether or not it is installed there."""
    if any(f.endswith("/strata.zip") for f in spark.sparkContext.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # Kept while the driver lives: executors fetch it when they start.
    folder = tempfile.mkdtemp(prefix="strata-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "strata"), "zip", os.path.dirname(here), os.path.basename(here)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only where the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/strata-{name}-{uuid.uuid4().hex[:12]}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing reads it any more (its readers' plans would fail)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose frames are gone: it does so when the driver's
    garbage is collected, which may be long after a job that left much on disk. What the first collection
    hands to finalizers goes in the second."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> tuple[str, DataFrame]:
    """The path of a scratch table with the rows of ``df``, as parquet (compressed by ``codec``, or as the
    session has it), and the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return path, spark.read.parquet(path)


def persist_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    This cuts lineage (a lost executor re-reads the table instead of
    re-running the shuffles behind it) and keeps the result columnar, so later
    passes read only the columns they need.
    """
    return stored(df, name, partition_by)[1]


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, with rows in at least as many partitions as there are cores. A table of few row groups
    is read by few tasks (splits of a file that begin no row group are empty), and whatever runs over its texts
    would keep the other cores idle; one of many is left as it is. Partitions with rows are counted without
    reading a column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= cores and df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(max(cores, parts))


TARGET_PARTITION_BYTES = 128 << 20


def configure_for(spark: SparkSession, input_bytes: int, target: int = TARGET_PARTITION_BYTES) -> dict[str, str]:
    """Size shuffles for an input of ``input_bytes``: about ``target`` bytes per
    shuffle partition (so a partition fits an executor's execution memory and
    spills rarely), scan splits of the same size, and AQE free to coalesce small
    partitions and split skewed ones. Returns the settings applied."""
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, -(-int(input_bytes) // target))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
