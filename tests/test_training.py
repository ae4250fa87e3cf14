from pyspark.sql import functions as F

from strata.operators import losses as LS
from strata.operators import training as TR
from strata.plans import catalog as C
from conftest import SF01


def test_linear_head_beats_floor(spark):
    d = C.emb_parts(spark, SF01)
    train = d.filter(F.col("part") == "train")
    model = TR.train_linear(train, weights=LS.class_weights(train))
    acc = TR.predict(model, train).agg(F.avg((F.col("label") == F.col("pred")).cast("double"))).first()[0]
    assert acc >= 0.3


def test_focal_descent_lowers_loss(spark):
    d = C.emb_parts(spark, SF01).filter(F.col("part") == "train")
    m = TR.train_focal(d, 10, 64, steps=8)
    losses = [l for _, l in m.history]
    assert all(b < a for a, b in zip(losses, losses[1:]))


def test_training_loop_records_epochs_and_keeps_best(spark):
    from strata.plans.train import train_run
    d = C.emb_parts(spark, SF01)
    run = train_run(d.filter(F.col("part") == "train"), d.filter(F.col("part") == "valid"), 10, 64,
                    epochs=4, steps_per_epoch=2, patience=2, run_id="t")
    rows = sorted(run.summary.collect(), key=lambda r: r.epoch)
    assert [r.epoch for r in rows] == list(range(len(rows)))
    losses = [r.train_loss for r in rows]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    best = min(rows, key=lambda r: (r.valid_loss, r.epoch))
    assert run.best_epoch == best.epoch


def test_focal_gradient_is_finite_for_any_gamma_and_equals_differences(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=4).tolist(), int(i % 3)) for i in range(30)] + [([900.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int")
    w, b = rng.normal(size=(3, 4)), np.zeros(3)
    w[0, 0], w[1, 0], w[2, 0] = 1.0, 0.0, 0.0

    def loss(v, gamma):
        r = {x.c: x.g for x in TR.focal_gradient(df, v, b, gamma=gamma).collect()}
        return r[3][0], np.array([r[c] for c in range(3)])
    for gamma in (0.0, 0.5, 2.0):
        at, g = loss(w, gamma)
        assert np.isfinite(g).all()
        up = w.copy()
        up[1, 2] += 1e-6
        assert abs((loss(up, gamma)[0] - at) / 1e-6 - g[1, 2]) < 1e-3


def test_wide_heads_are_scored_without_growing_the_plan(spark):
    from strata.operators.scoring import linear_scores
    w = [[0.5] * 768 for _ in range(225)]
    df = spark.createDataFrame([([1.0] * 768,), (None,)], "x array<double>").select(linear_scores("x", w).alias("z"))
    got = df.collect()
    assert got[0].z == [384.0] * 225 and got[1].z is None
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 2000


def _sparse_rows(spark, n=400, dims=60, classes=5, seed=3):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(classes))
        at = sorted({int(v) for v in rng.integers(1, dims - 1, 8)} | {1 + k})
        values = {j: float(rng.integers(1, 5)) for j in at} | {0: 0.1}  # the first feature has one value, the last none
        rows.append((i, k if rng.random() < 0.8 else int(rng.integers(classes)), Vectors.sparse(dims, values)))
    return spark.createDataFrame(rows, ["id", "label", "features"]).withColumn("label", F.col("label").cast("int"))


def test_sparse_head_takes_the_steps_of_the_library(spark):
    import numpy as np
    d = _sparse_rows(spark)
    weights = LS.class_weights(d.filter("label < 4"))  # the last class has weight 0
    for kwargs in ({"max_iter": 12}, {"max_iter": 12, "reg": 0.05}, {"max_iter": 60, "weights": weights}):
        own, library = TR.train_linear(d, sparse=True, **kwargs), TR.train_linear(d, **kwargs)
        assert np.allclose(own.history, library.summary.objectiveHistory, rtol=1e-6, atol=1e-9)
        a, b = ({r.id: (r.pred, r.probability) for r in TR.predict(m, d).collect()} for m in (own, library))
        assert all(a[i][0] == b[i][0] for i in b) and len(a) == d.count()
        assert np.allclose([a[i][1] for i in sorted(b)], [b[i][1] for i in sorted(b)], atol=1e-4)


def test_sparse_head_lays_out_wide_rows_in_bounded_matrices(spark, monkeypatch):
    import numpy as np
    from strata.operators import linear as L
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 700, 5, 40])
    index = np.concatenate([np.sort(rng.choice(100_000, c, replace=False)) for c in counts]).astype(np.int32)
    block = L.Block(100_000, counts, index, np.arange(1.0, 749.0), np.zeros(5, np.int32), np.ones(5))
    monkeypatch.setattr(L, "CELLS", 1500)
    whole, seen = np.zeros((5, 100_000)), 0
    for rows, cols, x in block.pieces(100_000):
        assert x.size <= 1500
        whole[rows, cols] += x
        seen += len(x)
    want = np.zeros((5, 100_000))
    want[np.repeat(np.arange(5), counts), index] = block.value
    assert seen == 5 and (whole == want).all()


def test_sparse_head_of_one_label_mixed_vectors_and_bad_rows(spark):
    import pytest
    from pyspark.ml.linalg import Vectors
    one = spark.createDataFrame([(2, Vectors.sparse(3, {0: 1.0})), (2, Vectors.dense([0.0, 2.0, 1.0]))], ["label", "features"])
    model = TR.train_linear(one, sparse=True)
    assert [(r.pred, r.probability) for r in TR.predict(model, one, keep=()).collect()] == [(2, [0.0, 0.0, 1.0])] * 2
    mixed = [(0, Vectors.sparse(3, {0: 1.0})), (1, Vectors.dense([0.0, 2.0, 1.0])), (0, Vectors.sparse(3, {})), (1, Vectors.dense([1.0, 2.0, 0.0])), (1, Vectors.sparse(3, {2: 1.0}))]
    d = spark.createDataFrame(mixed, ["label", "features"])
    own, library = (TR.train_linear(d, max_iter=5, reg=0.1, sparse=s) for s in (True, False))
    assert max(abs(a - b) for a, b in zip(own.history, library.summary.objectiveHistory)) < 1e-9
    for bad in ((-1, Vectors.dense([1.0, 1.0, 1.0])), (None, Vectors.dense([1.0, 1.0, 1.0])), (1, Vectors.dense([float("nan"), 1.0, 1.0]))):
        with pytest.raises(Exception, match="labels must be|NaN or infinite"):
            TR.train_linear(spark.createDataFrame([*mixed, bad], d.schema), sparse=True)
    with pytest.raises(ValueError):
        TR.train_linear(d.filter("label > 1"), sparse=True)


def test_text_query_uses_the_sparse_fit(spark, monkeypatch):
    fits, fit = [], TR.fit_linear
    monkeypatch.setattr(TR, "fit_linear", lambda *a: fits.append(fit(*a)) or fits[-1])
    got = C.QUERIES["train_text"](spark, SF01).collect()
    assert len(fits) == 1 and len(fits[0].history) > 1 and fits[0].history[-1] < fits[0].history[0]
    assert len(got) == len({r.id for r in got}) and {r.part for r in got} == {"test"}
