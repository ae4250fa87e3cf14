"""Training jobs against plain single-machine forms, and exact batches."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import heads as H
from strata.operators import permute as P
from strata.plans import catalog_training as CT
from conftest import SF01


@pytest.fixture(scope="module")
def data(spark):
    rows = sorted((r.id, r.label, list(r.embedding)) for r in CT.rows(spark, SF01).collect())
    return np.array([i for i, _, _ in rows]), np.array([x for _, _, x in rows], np.float64), np.array([y for _, y, _ in rows])


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_convex_fit_equals_newton_steps(spark):
    rng = np.random.default_rng(3)
    x, y, l2 = rng.normal(size=(120, 3)), rng.integers(0, 3, 120), 0.02
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "embedding array<double>, label int").repartition(5)
    fit = H.fit_convex(df, 3, 3, l2=l2)
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros((3, 4))
    for _ in range(30):
        p = softmax(a @ w.T)
        g = ((p - np.eye(3)[y]).T @ a) / len(a) + l2 * w
        hess = l2 * np.eye(12) + sum(np.kron(np.diag(q) - np.outer(q, q), np.outer(r, r)) for q, r in zip(p, a)) / len(a)
        w = w - np.linalg.solve(hess, g.ravel()).reshape(w.shape)
    assert np.abs(fit.weights - w).max() < 1e-8 and fit.gradient <= 1e-10 and fit.steps < 60
    with pytest.raises(RuntimeError):
        H.fit_convex(df, 3, 3, l2=l2, max_steps=1)


def test_cross_validation_equals_fits_fold_by_fold(spark, data):
    ids, x, y = data
    a = np.column_stack([x, np.ones(len(x))])
    folds = [int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16) % 4 for i in ids]
    got = H.cross_validate(CT.rows(spark, SF01), 10, 64, [0.0, 0.1], folds=4, steps=5, lr=2.0, seed=7)
    assert [(f, l2) for f, l2, *_ in got] == [(f, l2) for f in range(4) for l2 in (0.0, 0.1)]
    for f, l2, n, loss, acc in got:
        out = np.array(folds) == f
        w = np.zeros((10, 65))
        for _ in range(5):
            p = softmax(a[~out] @ w.T)
            w = w - 2.0 * (((p - np.eye(10)[y[~out]]).T @ a[~out]) / (~out).sum() + l2 * w)
        p = softmax(a[out] @ w.T)
        assert n == out.sum() and abs(loss - -np.log(p[np.arange(n), y[out]] + 1e-9).mean()) < 1e-9
        assert abs(acc - (p.argmax(1) == y[out]).mean()) < 1e-12


def plain_loss(head, x, y, ids, step):
    """The training loss at the head's parameters, written plainly."""
    a = x
    for layer, (w, b) in enumerate(zip(head.weights, head.bias)):
        if head.dropout:
            a = a * head.mask(step, layer, ids, a.shape[1])
        a = a @ w.T + b
        if layer < len(head.gain):
            if head.norm:
                axis = 0 if head.norm == "batch" else 1
                a = (a - a.mean(axis, keepdims=True)) / np.sqrt(a.var(axis, keepdims=True) + 1e-5) * head.gain[layer] + head.shift[layer]
            a = np.maximum(a, 0)
    p = softmax(a)
    return -np.log(p[np.arange(len(y)), y]).mean()


@pytest.mark.parametrize("norm,dropout,sizes", [(None, 0.0, [64, 6, 10]), ("batch", 0.3, [64, 6, 5, 10]), ("layer", 0.3, [64, 6, 5, 10]), (None, 0.0, [64, 10])])
def test_back_propagation_equals_differences(spark, data, norm, dropout, sizes):
    ids, x, y = data
    head = H.ReluHead(sizes, dropout=dropout, norm=norm, seed=5)
    head.shift = [np.full(len(s), 0.1) for s in head.shift]  # a row whose units all fell out is not at ReLU's corner
    before = [w.copy() for w in head.weights], [b.copy() for b in head.bias], [g.copy() for g in head.gain], [s.copy() for s in head.shift]
    start = H.ReluHead(sizes, dropout=dropout, norm=norm, seed=5)
    start.shift = [s.copy() for s in head.shift]
    H.fit_relu(CT.rows(spark, SF01).repartition(6), head, steps=1, lr=1.0)
    assert abs(head.history[0] - plain_loss(start, x, y, ids, 0)) < 1e-9
    rng = np.random.default_rng(0)
    groups = [("weights", before[0]), ("bias", before[1])] + ([("gain", before[2]), ("shift", before[3])] if norm else [])
    for name, old in groups:
        for layer, value in enumerate(old):
            for _ in range(3):
                at = tuple(int(rng.integers(0, n)) for n in value.shape)
                step = getattr(head, name)[layer][at] - value[at]
                params, h = getattr(start, name), 1e-6
                losses = []
                for sign in (1, -1):
                    params[layer][at] = value[at] + sign * h
                    losses.append(plain_loss(start, x, y, ids, 0))
                params[layer][at] = value[at]
                assert abs(-step - (losses[0] - losses[1]) / (2 * h)) < 1e-5, (name, layer, at)


def test_multi_layer_head_learns_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no linear head separates it
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, embedding array<double>, label int")
    head = H.fit_relu(df, H.ReluHead([4, 16, 2], norm="batch", seed=2), steps=40, lr=1.0, clip=5.0)
    assert head.history[-1] < 0.6 * head.history[0]
    got = head.transform(df).select("label", F.expr("z[1] > z[0]").alias("one")).collect()
    assert np.mean([int(r.one) == r.label for r in got]) > 0.85
    with pytest.raises(ValueError):
        H.ReluHead([4, 2], norm="group")


def test_one_shard_of_batches_equals_a_plain_loop_and_more_shards_lower_the_loss(spark, data):
    ids, x, y = data
    w, losses = H.fit_batches(CT.rows(spark, SF01), 10, 64, epochs=2, batch_size=64, lr=0.01, shard_batches=10_000, seed=9)
    v, seen = np.zeros((10, 65)), []
    for epoch in range(2):
        at = []
        for b in range(-(-len(ids) // 64)):
            pick = P.rows_of_batch(b, len(ids), 64, f"9:{epoch}")
            a, t = np.column_stack([x[pick], np.ones(len(pick))]), y[pick]
            count = np.bincount(t, minlength=10)
            inverse = np.where(count > 0, 1 / (np.maximum(count, 1) + 1e-9), 0)
            own = (inverse / inverse.sum() * 225)[t]
            p = softmax(a @ v.T)
            u = p[np.arange(len(t)), t]
            at.append((-own * np.log(u + 1e-9)).mean())
            v = v - 0.01 * ((p - np.eye(10)[t]) * (own * u / (u + 1e-9))[:, None]).T @ a / len(t)
        seen.append(np.mean(at))
    assert np.abs(w - v).max() < 1e-9 and np.abs(np.array(losses) - seen).max() < 1e-9
    several, _ = H.fit_batches(CT.rows(spark, SF01), 10, 64, epochs=4, batch_size=64, lr=1.0, shard_batches=3, seed=9)
    whole = [H.batch_step(at, x, y, 0.0, present_only=True)[1] for at in (np.zeros((10, 65)), several)]
    assert whole[1] < 0.95 * whole[0], whole
    # Unless only present classes count, those absent from a batch take almost all of the weight.
    assert H.batch_weights(np.array([0, 0, 1]), 3).sum() == pytest.approx(225) and H.batch_weights(np.array([0, 0, 1]), 3)[:2].sum() < 1e-5
    assert H.batch_weights(np.array([0, 0, 1]), 3, present_only=True)[:2].sum() == pytest.approx(225)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_exact_batches_are_a_permutation_and_any_batch_can_be_found_alone(spark, n):
    df = spark.createDataFrame([(3 * i - 50,) for i in range(n)], "id long").repartition(4)
    rows = P.exact_batches(df, 16, seed=1).collect()
    assert sorted(r.position for r in rows) == list(range(n))
    assert [r.row_no for r in sorted(rows, key=lambda r: r.id)] == list(range(n))
    of = {}
    for r in rows:
        of.setdefault(r.batch_id, {})[r.slot] = r.row_no
    assert all(len(v) == 16 for b, v in of.items() if b < (n - 1) // 16)
    for b, v in of.items():
        assert P.rows_of_batch(b, n, 16, 1) == [v[s] for s in sorted(v)]
    back = spark.range(n).select("id", P.permuted(P.permuted("id", n, 1), n, 1, inverse=True).alias("back"))
    assert back.filter("id <> back").count() == 0


def test_shuffled_order_is_spread_and_depends_on_the_seed(spark):
    n = 2000
    got = [[r[0] for r in spark.range(n).select(P.permuted("id", n, s).alias("p")).orderBy("id").collect()] for s in (1, 2)]
    assert sum(a == b for a, b in zip(*got)) < 20
    for p in got:
        halves = np.array(p).reshape(20, 100).mean(1)  # places of neighbouring rows are spread over the whole order
        assert np.abs(halves - n / 2).max() < 0.15 * n and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_export_is_in_order_within_and_across_files(spark, tmp_path):
    path = str(tmp_path / "x")
    P.shuffled_export(spark.range(500).withColumnRenamed("id", "id"), path, rows_per_file=100, batch_size=16, seed=3)
    rows = spark.read.parquet(path).select("position", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k")).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.f, r.k)):
        by_file.setdefault(r.f, []).append(r.position)
    runs = sorted(by_file.values())
    assert len(runs) == 5 and [p for run in runs for p in run] == list(range(500))
    P.shuffled_export(spark.range(0), str(tmp_path / "none"), 100)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
