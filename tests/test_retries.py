"""A task lost mid-job is re-run and draws the same rows (draws are md5 of keys)."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from strata.operators import bootstrap as B
from strata.operators import split as S
from conftest import SF01
from strata.plans import catalog as C


def _flaky(df):
    """Identity, except that every task's first attempt fails."""
    def fail_once(batches):
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("simulated executor loss")
        yield from batches
    return df.mapInPandas(fail_once, df.schema)


def test_retried_tasks_give_the_same_bags_and_split(spark):
    rows = C.labelled(spark, SF01).select("id", "label")
    want_bags = {(r.bag, r.id) for r in B.bootstrap(rows, 3, 300, "random", seed=9).collect()}
    got_bags = {(r.bag, r.id) for r in B.bootstrap(_flaky(rows), 3, 300, "random", seed=9).collect()}
    assert got_bags == want_bags
    want = {(r.id, r.part) for r in S.stratified_split(rows, test_ratio=0.1, seed=9).collect()}
    got = {(r.id, r.part) for r in S.stratified_split(_flaky(rows), test_ratio=0.1, seed=9).collect()}
    assert got == want
