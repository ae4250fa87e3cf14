"""Stream jobs with state of their own: any order of files, restarts, waits, late rows, bounded state."""

import time

import pytest
from pyspark.sql import functions as F

from strata.operators import runs as RN
from strata.streaming import jobs as ST, stateful as SS

COLS = ["run_id", "epoch", "improved", "patience", "stop"]
KEYS = ["user_id", "event_type"]


def _runs(spark):
    losses = {"falls": [9.0, 8, 7, 6, 5, 4, 3, 2], "stops": [3.0, 2, 2, 2.5, 2, 1, 1, 1], "ties": [1.0] * 8, "wild": [5.0, 7, 4, 9, 9, 9, 3, 9]}
    return spark.createDataFrame([(r, e, float(x)) for r, xs in losses.items() for e, x in enumerate(xs)], "run_id string, epoch int, valid_loss double")


def _write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are read in the order of their times


def _stop(spark, path, places, **args):
    return SS.run_stateful(SS.early_stop_stream(ST.read_stream(spark, path, files_per_batch=1), 3, **args), "t-stop", **places)


def _rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_early_stop_takes_epochs_in_any_order_and_after_a_restart(spark, tmp_path, order):
    runs, path = _runs(spark), str(tmp_path / "in")
    places = {"sink": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ckpt")}
    for k in order[:2]:
        _write(runs.filter(F.col("epoch") % 3 == k), path)
    _stop(spark, path, places)
    # The second run of the job goes on from the first one's state; an epoch that comes again is passed over.
    _write(runs.filter((F.col("epoch") % 3 == order[2]) | (F.col("epoch") == 1)), path)
    assert _rows(_stop(spark, path, places), COLS) == _rows(RN.early_stop(runs, 3), COLS)


def test_a_missing_epoch_is_waited_for_and_then_passed(spark, tmp_path):
    runs, path = _runs(spark).filter("run_id = 'wild'"), str(tmp_path / "in")
    places = {"sink": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ckpt")}
    _write(runs.filter("epoch in (0, 1, 3, 4)"), path)
    assert [r[1] for r in _rows(_stop(spark, path, places, wait_ms=100), COLS)] == [0, 1]
    # Any next data lets the timer fire; here of another run.
    _write(_runs(spark).filter("run_id = 'ties' and epoch = 0"), path)
    held = _stop(spark, path, places, wait_ms=100).filter("run_id = 'wild'")
    assert _rows(held, COLS) == _rows(RN.early_stop(runs.filter("epoch in (0, 1, 3, 4)"), 3), COLS)


def test_a_null_loss_never_improves_and_no_rows_give_none(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("n", 0, None), ("n", 1, 2.0), ("n", 2, None), ("n", 3, float("nan")), ("n", 4, 3.0)]
    _write(spark.createDataFrame(rows, "run_id string, epoch int, valid_loss double"), path)
    got = _rows(SS.run_stateful(SS.early_stop_stream(ST.read_stream(spark, path), 3), "t-null"), COLS)
    assert got == [("n", 0, 0, None, 0), ("n", 1, 1, 0, 0), ("n", 2, 0, 1, 0), ("n", 3, 0, 2, 0), ("n", 4, 0, 3, 1)]
    empty = str(tmp_path / "empty")
    _runs(spark).limit(0).write.parquet(empty)
    assert SS.run_stateful(SS.early_stop_stream(ST.read_stream(spark, empty), 3), "t-none", sink=str(tmp_path / "o"), checkpoint=str(tmp_path / "c")).count() == 0


def _events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_type string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")


def test_late_rows_go_beside_and_are_settled(spark, tmp_path):
    path = str(tmp_path / "in")
    days = [f"2024-01-{d:02d} 12:00:00" for d in range(1, 31)]
    first = [(1, "a", days[0]), (1, "a", days[0]), (None, None, days[0]), (2, "b", None)]
    later = [(1, "a", days[20]), (3, "c", days[20])]
    late = [(1, "a", days[0]), (4, "d", days[1]), (4, "d", days[1])]
    for rows in (first, later, [(9, "z", days[21])], late):
        _write(_events(spark, rows), path)
        time.sleep(0.3)
    stream = SS.dedup_bounded(ST.read_stream(spark, path, files_per_batch=1), KEYS, "ts", sweep_ms=50)
    sink = SS.run_stateful(stream, "t-late")
    day = F.date_format(SS.OPENED, "dd").alias("day")
    got = sink.select(*KEYS, day, "late").collect()
    # Day 1's entry is gone by then, so its repeat is late and settled by the sink; (4, d) has no other row.
    assert sorted(map(tuple, got), key=str) == sorted([
        (None, None, "01", False), (1, "a", "01", False), (1, "a", "21", False), (3, "c", "21", False), (9, "z", "22", False),
        (1, "a", "01", True), (4, "d", "02", True)], key=str)
    kept = {tuple(r) for r in SS.settled(sink, KEYS).select(*KEYS, day, "late").collect()}
    assert kept == {(None, None, "01", False), (1, "a", "01", False), (1, "a", "21", False), (3, "c", "21", False), (9, "z", "22", False), (4, "d", "02", True)}


def test_state_holds_the_open_windows_only(spark, tmp_path):
    path, per_day = str(tmp_path / "in"), 40
    for d in range(1, 9):
        _write(_events(spark, [(u, "a", f"2024-01-{d:02d} 12:00:00") for u in range(per_day)]), path)
    stream = SS.dedup_bounded(ST.read_stream(spark, path, files_per_batch=1), KEYS, "ts", sweep_ms=10)
    settings = {k: spark.conf.get(k) for k in SS.SETTINGS}
    try:
        for k, v in SS.SETTINGS.items():
            spark.conf.set(k, v)
        q = (stream.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
             .format("parquet").option("path", str(tmp_path / "out")).start())
        q.awaitTermination()
    finally:
        for k, v in settings.items():
            spark.conf.set(k, v)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 4 * per_day
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8 * per_day


def test_a_whole_table_sink_keeps_the_last_whole_version(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = ST._version_to(path)
    for epoch in range(3):
        write(spark.range(epoch + 1), epoch)
    assert ST._versions(spark, path) == [1, 2] and ST.read_sink(spark, path).count() == 3
    # A batch that died before its end leaves the version before it in place.
    (tmp_path / "sink" / "version-3").mkdir()
    assert ST.read_sink(spark, path).count() == 3


def test_state_keeps_the_keys_of_a_window_in_few_entries(spark, tmp_path):
    path, big = str(tmp_path / "in"), 2**53 + 1
    rows = [(u, t, "2024-01-01 12:00:00") for u in range(300) for t in "ab"] + [(big, "a", "2024-01-01 12:00:00"), (None, "a", "2024-01-01 12:00:00")]
    for k in range(2):
        _write(_events(spark, rows[k * 300:] + rows[:50]), path)
    stream = SS.dedup_bounded(ST.read_stream(spark, path, files_per_batch=1), KEYS, "ts", buckets=4)
    settings = {k: spark.conf.get(k) for k in SS.SETTINGS}
    try:
        for k, v in SS.SETTINGS.items():
            spark.conf.set(k, v)
        q = (stream.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
             .format("parquet").option("path", str(tmp_path / "out")).start())
        q.awaitTermination()
    finally:
        for k, v in settings.items():
            spark.conf.set(k, v)
    # One entry a key would be 602 of them.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    got = spark.read.parquet(str(tmp_path / "out")).filter("not late").select(*KEYS).collect()
    assert sorted(map(tuple, got), key=str) == sorted({r[:2] for r in rows}, key=str)


def test_keys_of_any_plain_type_come_out_as_they_were(spark, tmp_path):
    path = str(tmp_path / "in")
    keyed = "d double, s string, b boolean, day date, at timestamp, n decimal(9,2), raw binary"
    rows = spark.sql("select cast(c1 as double) d, c2 s, c3 b, date'2024-02-29' day, timestamp'2024-02-29 01:02:03.000004' at, cast(1.25 as decimal(9,2)) n, "
                     "cast('x' as binary) raw, timestamp'2024-03-01 00:00:00' ts from values ('1.5', 'x', true), (null, null, null), (null, null, null), ('-2', '', false), ('1.5', 'x', true)"
                     " as t(c1, c2, c3)")
    _write(rows, path)
    keys = [k.split()[0] for k in keyed.split(", ")]
    sink = SS.run_stateful(SS.dedup_bounded(ST.read_stream(spark, path), keys, "ts"), "t-types")
    cols = [F.col(k).cast("string") for k in keys]
    assert sorted(map(tuple, sink.select(*cols).collect()), key=str) == sorted(map(tuple, rows.select(*cols).distinct().collect()), key=str)
