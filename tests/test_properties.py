"""Randomized checks against brute force (few examples: each runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings, strategies as st

from strata.operators import features as FT

_counts = st.dictionaries(st.text(alphabet="abcdef", min_size=1, max_size=3), st.integers(1, 6), min_size=1, max_size=25)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=_counts, size=st.integers(1, 30))
def test_top_counts_equals_sorting(spark, counts, size):
    df = spark.createDataFrame(sorted(counts.items()), "token string, n long")
    got = sorted((r.token, r.n) for r in FT.top_counts(df, size).collect())
    want = sorted(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:size])
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(1, 130), min_size=1, max_size=4), seed=st.integers(0, 99))
def test_split_equals_window_form(spark, sizes, seed):
    from pyspark.sql import Window, functions as F
    from strata.operators import split as S
    rows = [(lab * 1000 + i, lab) for lab, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = {(r.id, r.part) for r in S.stratified_split(df, test_ratio=0.1, seed=seed).collect()}
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    w = Window.partitionBy("label").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id")
    ref = (df.withColumn("n", n).withColumn("rk", F.row_number().over(w))
           .withColumn("part", F.when(F.col("rk") <= S.test_quota(F.col("n"), 0.1), "test").otherwise("train")))
    assert got == {(r.id, r.part) for r in ref.collect()}
