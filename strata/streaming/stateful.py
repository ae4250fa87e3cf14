"""Stream jobs that keep state of their own per key.

``early_stop_stream`` follows runs epoch by epoch in a state processor; ``dedup_bounded`` keeps
the first row of a key in each time window and forgets a window once the watermark has passed it.
Both run on the RocksDB state store, which ``run_stateful`` sets for the query it starts.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, IntegralType, StringType, StructField, StructType, TimestampType

from strata.streaming import jobs as ST

#: State is kept on the executor's disk rather than its heap; and no batches without
#: data, of which a state processor on processing time asks for one after the other, so that a run
#: over what is there now ends (timers that are due fire with the next data).
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

# The process that starts a state processor on the driver does not get the files shipped to executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def run_stateful(stream: DataFrame, name: str, **places: str) -> DataFrame:
    """``jobs.run`` under SETTINGS; the session's own are put back."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            conf.set(k, v)
        return ST.run(stream, name, **places)
    finally:
        for k, v in before.items():
            conf.set(k, v)


# --- E4 -----------------------------------------------------------------------------------

class StopRule(StatefulProcessor):
    """One run: its best loss, the epoch of it, whether it has stopped, and the epochs that came early.

    Epochs are taken in order whatever order they come in. One that is missing is waited for
    ``wait_ms`` of processing time; then the run goes on from the next epoch there is. An epoch
    that comes again, or after the run went on without it, is passed over.
    """

    def __init__(self, patience: int, first_epoch: int, wait_ms: int) -> None:
        self.patience, self.first_epoch, self.wait_ms = patience, first_epoch, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, best double, best_epoch long, stopped boolean")
        self.early = handle.getMapState("early", "epoch long", "valid_loss double")

    def _steps(self, run_id, at: tuple, skip: bool) -> Iterator[pd.DataFrame]:
        due, best, best_epoch, stopped = at
        if skip:
            due = min((k[0] for k in self.early.keys()), default=due)
        out = []
        while self.early.containsKey((due,)):
            loss = self.early.getValue((due,))[0]
            self.early.removeKey((due,))
            better = loss is not None and loss < best
            if better:
                best, best_epoch = loss, due
            since = None if best_epoch is None else due - best_epoch
            stop = not stopped and since is not None and since >= self.patience
            stopped = stopped or stop
            out.append((run_id, due, int(better), since, int(stop)))
            due += 1
        self.at.update((due, best, best_epoch, stopped))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "epoch", "improved", "patience", "stop"]).astype({"patience": "Int32"})

    def _state(self) -> tuple:
        return tuple(self.at.get()) if self.at.exists() else (self.first_epoch, math.inf, None, False)

    def _wait(self, now: int) -> None:
        """A timer while epochs are held that cannot be taken yet, and none otherwise."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(True for _ in self.early.keys()):
            self.handle.registerTimer(now + self.wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self._state()
        for part in rows:
            for epoch, loss in zip(part["epoch"], part["valid_loss"]):
                if epoch >= at[0] and not self.early.containsKey((int(epoch),)):
                    self.early.updateValue((int(epoch),), (None if pd.isna(loss) else float(loss),))
        yield from self._steps(key[0], at, skip=False)
        self._wait(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._steps(key[0], self._state(), skip=True)
        self._wait(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def early_stop_stream(summary: DataFrame, patience: int, first_epoch: int = 0, wait_ms: int = 3_600_000) -> DataFrame:
    """E4 on a stream of (run_id, epoch, valid_loss): the rows of ``runs.early_stop`` as epochs come,
    in any order of rows and files. A loss that is null never improves."""
    rows = summary.select("run_id", F.col("epoch").cast("long").alias("epoch"), F.col("valid_loss").cast("double").alias("valid_loss"))
    run_type = rows.schema["run_id"].dataType.simpleString()
    return rows.groupBy("run_id").transformWithStateInPandas(
        StopRule(patience, first_epoch, wait_ms), f"run_id {run_type}, epoch long, improved int, patience int, stop int", "append", "processingTime")


# --- J3 -----------------------------------------------------------------------------------

OPENED, LATE = "window_start", "late"
#: The keys of a window are dealt by their hash into at most this many entries of state: a call of
#: the state function costs a millisecond or more, whether it is for one key or for thousands.
BUCKETS = 1024


def dedup_bounded(events: DataFrame, keys: list[str], time_col: str, window: str = "1 day", delay: str = "1 day",
                  sweep_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """J3 with bounded state: the first row of every key in each window of event time.

    An entry holds the keys of a bucket of a window; it is looked at every ``sweep_ms`` of processing
    time and forgotten once the watermark
    (the latest time seen, less ``delay``) has passed the end of its window. A row of such a window
    whose key is not known is passed on with ``late`` true instead of being dropped, since whether
    it was seen can no longer be told here; ``settled`` tells it from the sink. Rows without a time
    belong to no window and are left out.
    """
    schema = StructType([*[events.schema[k] for k in keys], StructField(OPENED, TimestampType()), StructField(LATE, BooleanType())])
    # Whole numbers pass through Python as text: beside nulls pandas would make floats of them.
    whole = [k for k in keys if isinstance(events.schema[k].dataType, IntegralType)]
    passed = StructType([StructField(f.name, StringType()) if f.name in whole else f for f in schema])
    timed = events.select(*keys, F.col(time_col).cast("timestamp").alias("_at")).filter("_at is not null").select("*", F.window("_at", window).alias("_w"))
    opened = timed.select(*keys, F.unix_micros("_w.start").alias("_from"), F.unix_millis("_w.end").alias("_to"), "_at")
    group = [*keys, "_from", "_to"]

    def latest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            most = pa.Table.from_batches([p]).group_by(group).aggregate([("_at", "max")])
            yield from most.select([*group, "_at_max"]).rename_columns([*group, "_at"]).to_batches()

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        _, opens, ends = key
        over = ends <= state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            state.remove() if over else state.setTimeoutDuration(sweep_ms)
            return
        seen = pickle.loads(state.get[0]) if state.exists else set()
        new = []
        for p in parts:
            for k in p["_key"]:
                # A NaN equals itself here, as in a grouping.
                same = tuple(v if v == v else ... for v in k.values())
                if same not in seen:
                    seen.add(same)
                    new.append(k)
        if new and not over:
            state.update((pickle.dumps(seen),))
        if state.exists:
            state.setTimeoutDuration(sweep_ms)
        if new:
            objects = (StringType, BooleanType)
            cols = {k: pd.Series([r[k] for r in new], dtype=object if isinstance(passed[k].dataType, objects) else None) for k in keys}
            yield pd.DataFrame({**cols, OPENED: pd.Timestamp(opens, unit="us"), LATE: over})

    # A hot key leaves an Arrow batch as one row, before the shuffle by bucket; the latest time stays for
    # the watermark. Timeouts by processing time: by event time Spark itself would drop the late rows.
    fewer = opened.mapInArrow(latest, opened.schema).withWatermark("_at", delay)
    # The keys travel as one struct: a single column to convert for each group.
    dealt = fewer.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), "_from", "_to", F.struct(*[F.col(k).cast(passed[k].dataType).alias(k) for k in keys]).alias("_key"), "_at")
    found = dealt.groupBy("_bucket", "_from", "_to").applyInPandasWithState(
        first, passed, StructType([StructField("seen", BinaryType())]), "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def settled(sink: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the sink of ``dedup_bounded`` once per key and window: a late row is kept only
    if its window has none in time."""
    return sink.groupBy(*keys, OPENED).agg(F.min(LATE).alias(LATE))
