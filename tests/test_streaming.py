"""Stream jobs equal their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from strata.operators import metrics as M
from strata.streaming import jobs as ST
from conftest import SF01


def test_stream_confusion_equals_batch(spark):
    emb = f"{SF01}/embeddings.parquet"
    stream = ST.run(ST.confusion_stream(ST.argmax_stream(ST.read_stream(spark, emb), 10), 10), "t-conf", "complete")
    batch = M.confusion(ST.argmax_stream(spark.read.parquet(emb), 10), 10)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


KEYS = ["user_id", "event_type"]


def _files(spark, tmp_path, order):
    """The events table in four files; Spark reads files in order of their time."""
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    cuts = [r[0] for r in ev.selectExpr("percentile_approx(cast(cast(ts as timestamp) as double), array(0.25, 0.5, 0.75), 10000) as c").collect()][0]
    t = F.col("ts").cast("timestamp").cast("double")
    part = F.when(t < cuts[0], 0).when(t < cuts[1], 1).when(t < cuts[2], 2).otherwise(3)
    for k in order:
        ev.filter(part == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    return str(tmp_path / "in"), ev


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_stream_dedup_does_not_depend_on_files_or_their_order(spark, tmp_path, order):
    path, ev = _files(spark, tmp_path, order)
    kept = ST.run(ST.dedup_stream(ST.read_stream(spark, path, files_per_batch=1), KEYS), "t-dedup")
    assert sorted(map(tuple, kept.select(*KEYS).collect())) == sorted(map(tuple, ev.select(*KEYS).distinct().collect()))
    assert set(kept.columns) >= {"event_id", "ts", "user_id", "event_type"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, ev = _files(spark, tmp_path, (3, 1))
    places = {"sink": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ckpt")}
    ST.run(ST.dedup_stream(ST.read_stream(spark, path, files_per_batch=1), KEYS), "t", **places)
    _, ev = _files(spark, tmp_path, (0, 2))
    kept = ST.run(ST.dedup_stream(ST.read_stream(spark, path, files_per_batch=1), KEYS), "t", **places)
    assert sorted(map(tuple, kept.select(*KEYS).collect())) == sorted(map(tuple, ev.select(*KEYS).distinct().collect()))
    with pytest.raises(ValueError):
        ST.run(ST.dedup_stream(ST.read_stream(spark, path), KEYS), "t", sink=places["sink"])
