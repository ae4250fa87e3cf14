"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

Document statistics (no labels, language, source or id among them) are standardised with
moments over all documents and mapped by D cosines with Gaussian frequencies, whose inner
products approximate a Gaussian kernel. Each partition of the labelled training rows sums
its part of the normal equations; the parts are added by matrix row in the cluster, and
the driver solves one D x D system (D is a parameter, so its size is fixed). A quarter of
the training rows is left out of the fit; their scores, counted in a fixed number of bins,
are made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import map_arrow
from strata.llm.stats import share, with_counts
from strata.session import persist_table

FEATURES, KERNEL_WIDTH, RIDGE, SEED = 192, 2.5, 1e-3, 17
BINS, LOW, HIGH = 2000, -0.5, 1.5
#: Weight of the plain score in the calibrated one, so that rows on one step of the isotonic
#: function keep their order.
TIE = 1e-3


def vector(s: str = "_stats") -> list[Column]:
    """Statistics of a document; an empty text has defined values."""
    c = lambda f: F.col(f"{s}.{f}")
    n, chars = c("n_words"), c("word_chars")
    return [
        F.log((chars + 50.0) / (n + 10.0)),
        F.sqrt(share(c("n_symbols"), n, 5)),
        F.sqrt(share(c("n_marks"), n, 5)),
        F.sqrt(share(c("n_upper"), chars, 30)),
        F.sqrt(share(c("n_digits"), chars, 30)),
        F.sqrt(share(c("n_repeat_words"), n, 5)),
        F.sqrt(share(c("n_dup_lines"), c("n_lines"), 2)),
        share(c("n_distinct_words"), n, 5),
        F.log1p(n),
    ]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1: never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few arrays whose sizes are fixed by parameters."""

    mean: np.ndarray
    spread: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    bias: float
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.sqrt(2.0 / self.freq.shape[1]) * np.cos(z @ self.freq + self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        plain = np.clip((r - LOW) / (HIGH - LOW), 0, 1)
        return np.clip((1 - TIE) * np.interp(r, self.knots, self.values) + TIE * plain, 0, 1)


def _matrix(a: pa.Array) -> np.ndarray:
    return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1)


def normal_equations(rows: DataFrame, features: Callable[[np.ndarray], np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    """rows (x array<double>, y double) -> sums of [z 1]'[z 1] and [z 1]'y.

    Every partition emits one row per matrix row; these are added by row number in the cluster.
    """

    def part(batches):
        a = np.zeros((d + 1, d + 2))
        for b in batches:
            if b.num_rows:
                z = np.column_stack([features(_matrix(b.column(0))), np.ones(b.num_rows)])
                a += z.T @ np.column_stack([z, np.asarray(b.column(1), dtype=np.float64)])
        if a.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([_matrix(c) .sum(axis=0) for c in t.column(1).chunks if len(c)], axis=0)
        return pa.table({"i": t.column(0)[:1], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(part, "i int, v array<double>")
    got = parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()
    a = np.zeros((d + 1, d + 2))
    for r in got:
        a[r.i] = r.v
    return a[:, :-1], a[:, -1]


def pool_adjacent(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The nondecreasing means nearest to total / weight (adjacent violators pooled)."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return np.concatenate([np.full(int(n), t / w) for w, t, n in blocks])


def fit(vectors: DataFrame, labelled: DataFrame, d: int = FEATURES, name: str = "rff") -> Model:
    """vectors (x) of all documents give the standardisation; labelled (x, y, part) rows with
    part 0..3 give the fit (1..3) and the calibration (0).

    Without labelled rows the model scores 0.5 everywhere.
    """
    p = len(vector())
    m = vectors.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(p) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([m[f"avg{i}"] or 0.0 for i in range(p)])
    spread = np.maximum([m[f"stddev_pop{i}"] or 0.0 for i in range(p)], 0.02)
    rng = np.random.default_rng(SEED)
    shell = Model(mean, spread, rng.normal(0, 1 / KERNEL_WIDTH, (p, d)), rng.uniform(0, 2 * np.pi, d), np.zeros(d), 0.5,
                  np.array([LOW, HIGH]), np.array([0.5, 0.5]))
    a, b = normal_equations(labelled.filter("part > 0").select("x", "y"), shell.features, d)
    if a[-1, -1] == 0:
        a, b = normal_equations(labelled.select("x", "y"), shell.features, d)
    n = a[-1, -1]
    if n == 0:
        return shell
    ridge = np.eye(d + 1) * RIDGE * n
    ridge[-1, -1] = 0.0
    w = np.linalg.solve(a + ridge, b)
    raw = Model(**{**shell.__dict__, "weight": w[:-1], "bias": float(w[-1])})

    def bins(t: pa.RecordBatch) -> pa.RecordBatch:
        k = np.clip((raw.raw(_matrix(t.column(0))) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(k), t.column(1)], names=["k", "y"])

    held = labelled.filter("part = 0")
    counted = (map_arrow(held.select("x", "y"), bins, "k int, y double").groupBy("k")
               .agg(F.count("*").alias("n"), F.sum("y").alias("t")).orderBy("k").collect())  # at most BINS rows
    if not counted:
        return Model(**{**raw.__dict__, "knots": np.array([0.0, 1.0]), "values": np.array([0.0, 1.0])})
    knots = LOW + (np.array([r.k for r in counted]) + 0.5) * (HIGH - LOW) / BINS
    values = pool_adjacent(np.array([float(r.n) for r in counted]), np.array([r.t for r in counted]))
    return Model(**{**raw.__dict__, "knots": knots, "values": values})


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: documents with a label that are not held out. Several labels of a document
    are averaged; null labels and ids are ignored."""
    y = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
         .agg(F.avg(F.col("quality").cast("double")).alias("y")))
    return (stats.filter(~held_out(F.col("doc_id"))).join(y, "doc_id")
            .select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("part")))


def train(stats: DataFrame, labels: DataFrame, name: str = "rff") -> Model:
    return fit(stats.select("x"), _labelled(stats, labels), name=name)


def scorer(model: Model) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)) if len(x) else np.empty(0), pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, name: str = "rff") -> DataFrame:
    """documents (doc_id, text, ...), labels (doc_id, quality, ...) -> doc_id, held_out, score,
    predicted; a row per input row. Null and empty texts are scored by their (zero) counts."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = persist_table(with_counts(bare).select("doc_id", F.array(*vector()).alias("x")), f"{name}-stats")
    out = stats.withColumn("score", scorer(train(stats, labels, name))(F.col("x")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, name: str = "rff-stage") -> DataFrame:
    """The documents scored at the threshold or above, with their columns as they were."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = persist_table(with_counts(bare).select("doc_id", F.array(*vector()).alias("x")), f"{name}-stats")
    score = scorer(train(stats, labels, name))
    # Columns go by place, so that no name clashes and a text is held once beside the Python stage.
    names, place = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    row = with_counts(docs.toDF(*place), place[names.index("text")])
    kept = row.withColumn("_x", F.array(*vector())).filter(score(F.col("_x")) >= threshold)
    return kept.select(*[F.col(p).alias(n) for n, p in zip(names, place)])
