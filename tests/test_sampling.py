"""Split, upsampling and bagging invariants."""

from pyspark.sql import Window, functions as F

from strata.operators import bootstrap as B
from strata.operators import ranking as R
from strata.operators import split as S
from strata.operators import upsample as U
from strata.operators.dims import checked
from strata.plans import catalog as C
from conftest import SF01


def _ref_k(n, ratio):
    if n < 3:
        return 0
    if n <= 5:
        return 1
    if n <= 10:
        return 2
    if n < 100:
        return int(8 / 90 * n + 10 / 9)
    return int(n * ratio)


def test_test_quota_formula(spark):
    df = spark.range(0, 121).select(F.col("id").alias("n"))
    got = {r.n: r.k for r in df.select("n", S.test_quota(F.col("n"), 0.1).alias("k")).collect()}
    assert got == {n: min(_ref_k(n, 0.1), n) for n in range(121)}


def _classes(spark, sizes):
    rows = [(i, lab) for lab, n in enumerate(sizes) for i in range(n)]
    rows = [(lab * 1000 + i, lab, f"t{lab}_{i}" if i % 4 != 1 else "", "", "") for i, lab in rows]
    return spark.createDataFrame(rows, "id long, label int, text_obj string, text_mthd string, text_deal string")


def test_split_partition_invariants(spark):
    df = C.labelled(spark, SF01)
    sp = S.stratified_split(df, test_ratio=0.1, seed=7)
    assert sp.count() == df.count()
    assert sp.select("id").distinct().count() == df.count()
    small = sp.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("part") == "test").cast("int")).alias("t"))
    assert small.filter((F.col("n") < 3) & (F.col("t") > 0)).count() == 0


def test_bucketed_rank_equals_window_rank(spark):
    df = _classes(spark, [1, 2, 7, 40, 300])
    w = Window.partitionBy("label").orderBy(F.md5(F.concat_ws(":", F.lit("9"), F.col("id").cast("string"))), "id")
    want = {(r.id, r.rk) for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    got = {(r.id, r.rank) for r in R.rank_within(df, ["label"], 9).collect()}
    assert got == want


def test_split_does_not_depend_on_partitioning(spark):
    df = _classes(spark, [3, 9, 50, 400])
    a = {(r.id, r.part) for r in S.stratified_split(df.repartition(3), test_ratio=0.2, seed=1).collect()}
    b = {(r.id, r.part) for r in S.stratified_split(df.repartition(11), test_ratio=0.2, seed=1).collect()}
    assert a == b


def test_upsample_reaches_minimum(spark):
    df = _classes(spark, [1, 3, 8, 30])
    for fn in (U.upsample_random, U.upsample_uniform, U.upsample_shuffle):
        out = fn(df, minimum=20, seed=3)
        sizes = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert sizes == {0: 20, 1: 20, 2: 20, 3: 30}, fn.__name__
        assert out.filter(F.col("copy") == 0).count() == df.count()


def test_all_empty_class_keeps_its_originals(spark):
    df = spark.createDataFrame([(1, 0, "", "", ""), (2, 1, "x", "", "")],
                               "id long, label int, text_obj string, text_mthd string, text_deal string")
    out = U.upsample_random(df, minimum=5, seed=1)
    sizes = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 1, 1: 5}


def test_mix_columns_adds_bround_frac_rows(spark):
    df = _classes(spark, [5, 25, 35])
    out = U.mix_columns(df, frac=0.1, seed=3)
    assert out.count() == 65 + 0 + 2 + 4  # bround(0.5)=0, bround(2.5)=2, bround(3.5)=4


def test_random_quotas_sum_to_total(spark):
    df = _classes(spark, [2, 5, 900, 1200, 60])
    sizes = checked(df.groupBy("label").agg(F.count("*").alias("n")))
    q = B.quotas_random(sizes, 4, 1000, 2, 5).df
    tot = {r.bag: r.s for r in q.groupBy("bag").agg(F.sum("k").alias("s")).collect()}
    assert tot == {0: 1000, 1: 1000, 2: 1000, 3: 1000}
    n = {r.label: r.n for r in sizes.df.collect()}
    assert all(0 <= r.k <= n[r.label] for r in q.collect())
    bags = B.take_bags(df, B.quotas_random(sizes, 4, 1000, 2, 5), 4, 5)
    assert {r.bag: r.c for r in bags.groupBy("bag").agg(F.count("*").alias("c")).collect()} == tot


def test_oob_is_disjoint_from_bags(spark):
    df = _classes(spark, [3, 10, 40])
    bags = B.bootstrap(df, 3, 20, "same", seed=2)
    oob = B.out_of_bag(df, bags)
    assert oob.join(bags, "id").count() == 0
    assert oob.count() + bags.select("id").distinct().count() == df.count()


def test_same_quota_rejects_too_large_total(spark):
    df = _classes(spark, [3, 4])
    import pytest
    with pytest.raises(ValueError):
        B.bootstrap(df, 2, 100, "same")


def test_bags_and_upsampling_do_not_depend_on_partitioning(spark):
    df = _classes(spark, [2, 6, 30, 250])
    def bags(d):
        return {(r.bag, r.id) for r in B.bootstrap(d, 3, 120, "random", seed=4).collect()}
    def ups(d):
        return {(r.label, r.id, r.copy, r.slot, r.text_obj) for r in U.upsample_shuffle(d, minimum=40, seed=4).collect()}
    a, b = df.repartition(2), df.repartition(13)
    assert bags(a) == bags(b)
    assert ups(a) == ups(b)


def test_preprocess_upsamples_train_only(spark):
    from strata.plans.preprocess import preprocess
    from strata.sources.corpus import corpus
    from strata.sources.tables import table
    frame = corpus(table(spark, SF01, "documents"))
    plain = preprocess(frame, test_ratio=0.1, seed=42).rows
    up = preprocess(frame, test_ratio=0.1, seed=42, upsample="uniform", minimum=30).rows
    test_a = {(r.id, r.text) for r in plain.filter("part = 'test'").collect()}
    test_b = {(r.id, r.text) for r in up.filter("part = 'test'").collect()}
    assert test_a == test_b
    orig = {r.id for r in plain.filter("part = 'train'").collect()}
    assert orig <= {r.id for r in up.filter("part = 'train' and copy = 0").collect()}
    sizes = up.filter("part = 'train'").groupBy("label").count().collect()
    assert min(r["count"] for r in sizes) >= 1
    assert not ({r.id for r in plain.filter("part = 'train'").collect()} & {i for i, _ in test_a})


def test_bucket_digits_grow_with_the_largest_class():
    assert R.bucket_digits(1_000) == 3
    assert R.bucket_digits(50_000 * 4096) == 3
    assert R.bucket_digits(3 * 10**10) == 5
    assert R.bucket_digits(10**18) == R.MAX_DIGITS


def test_finer_buckets_give_the_same_ranks(spark):
    df = _classes(spark, [3, 50, 700])
    a = {(r.id, r.rank) for r in R.rank_within(df, ["label"], 5, digits=3).collect()}
    b = {(r.id, r.rank) for r in R.rank_within(df, ["label"], 5, digits=6).collect()}
    assert a == b


def test_num_test_is_a_ratio_of_the_deduplicated_rows(spark):
    df = C.labelled(spark, SF01)
    n = df.count()
    a = {(r.id, r.part) for r in S.stratified_split(df, num_test=150, seed=3).collect()}
    b = {(r.id, r.part) for r in S.stratified_split(df, test_ratio=150 / n, seed=3).collect()}
    assert a == b


def test_preprocess_honours_the_target_level(spark):
    from strata.plans.preprocess import preprocess
    from strata.sources.corpus import corpus
    from strata.sources.tables import table
    frame = corpus(table(spark, SF01, "documents"))
    large = preprocess(frame, test_ratio=0.1, level="L")
    codes = {r.digit for r in large.label_map.collect()}
    assert codes <= {"A", "B", "C", "D", "Z"} and len(codes) == large.classes.rows
    medium = preprocess(frame, test_ratio=0.1, level="M")
    assert all(len(r.digit) == 2 for r in medium.label_map.collect())
    assert large.rows.count() == medium.rows.count()


def test_quotas_of_tens_of_billions_of_rows_sum_exactly(spark):
    sizes = checked(spark.createDataFrame([(c, n) for c, n in enumerate([50_000_000_000, 30_000_000_000, 7, 2, 1_000, 900_000_000])], "label int, n long"))
    total = 10_000_000_000
    for seed in (1, 2):
        q = B.quotas_random(sizes, 2, total, seed=seed).df.groupBy("bag").agg(F.sum("k").alias("k"), F.min("k").alias("lo")).collect()
        assert [r.k for r in q] == [total, total] and all(r.lo >= 0 for r in q)


def test_slots_of_a_large_class_come_from_many_rows(spark):
    df = spark.createDataFrame([(0, 3_000_000_000), (1, 5), (2, 0)], "label int, k long")
    plan = B.slot_rows(df, F.col("k"), ["label"])
    assert plan.filter("label = 1").count() == 5
    chunks = df.filter("k > 0").selectExpr("label", f"(k - 1) div {B.SLOT_CHUNK} + 1 as c").collect()
    assert {r.label: r.c for r in chunks} == {0: 3000, 1: 1}


def test_draws_reach_beyond_32_bits(spark):
    from strata.functions.hashing import draw
    got = spark.range(1000).select(draw(1, F.col("id")).alias("d")).agg(F.max("d"), F.min("d")).first()
    assert got[0] > 2**59 and 0 <= got[1] < 2**60


def test_shuffled_texts_are_never_all_empty_and_follow_the_conditional_law(spark):
    rows = [(0, i, "a" if i < 2 else "", "b" if i == 2 else "", "") for i in range(10)] + [(1, 50 + i, "", "", "") for i in range(4)]
    df = spark.createDataFrame(rows, "label int, id long, text_obj string, text_mthd string, text_deal string")
    out = [r for r in U.upsample_shuffle(df, minimum=4000, seed=3).collect() if r.copy == -1]
    assert {r.label for r in out} == {0} and len(out) == 3990
    assert all(r.text_obj or r.text_mthd for r in out)
    # P(first given | some given) = 0.2 / (1 - 0.8 * 0.9)
    share = sum(bool(r.text_obj) for r in out) / len(out)
    assert abs(share - 0.2 / 0.28) < 0.04


def test_no_text_is_broadcast_by_the_upsamplers(spark):
    rows = C.labelled(spark, SF01).select("label", "id", "text_obj", "text_mthd", "text_deal")
    for fn in (U.upsample_random, U.upsample_uniform, U.upsample_shuffle):
        plan = fn(rows, minimum=50)._jdf.queryExecution().optimizedPlan().toString()
        hinted = [x for x in plan.splitlines() if "ResolvedHint" in x or "strategy=broadcast" in x]
        assert all("text_" not in x for x in hinted)
