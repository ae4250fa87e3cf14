"""Classifier heads trained as Spark jobs.

I1/I2 are ``pyspark.ml`` estimators; I1 on sparse rows is fitted by ``linear``, in the same steps. I3 trains a linear head under the focal
loss by full-batch gradient descent: each step broadcasts W (C x D, bounded),
every partition returns its partial gradient from ``mapInPandas`` (numpy on
an Arrow batch), and one aggregate sums them by place; the driver holds only W.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from strata.functions.arrays import argmax, softmax
from strata.functions.hashing import draw
from strata.operators.dims import Dim, join_dim
from strata.operators.features import tokens
from strata.operators.linear import LinearModel, fit_linear
from strata.operators.losses import EPS, FOCAL_ALPHA, FOCAL_GAMMA
from strata.operators.scoring import linear_scores


def holdout(df: DataFrame, seed=42, id_col: str = "id", valid_every: int = 5, part_col: str = "part") -> DataFrame:
    """Seeded train/valid assignment by hash of the id (every row kept)."""
    return df.withColumn(part_col, F.when(F.pmod(draw(seed, F.col(id_col)), F.lit(valid_every)) == 0, "valid")
                         .otherwise("train"))


def vector_features(df: DataFrame, array_col: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def text_features(df: DataFrame, text_col: str = "text", num_features: int = 1 << 18, out: str = "features"):
    """HashingTF + IDF over whitespace tokens; returns (frame, fitted IDF model)."""
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    with_tf = tf.transform(df.withColumn("_tokens", tokens(text_col)))
    idf = IDF(inputCol="_tf", outputCol=out).fit(with_tf)
    return idf.transform(with_tf).drop("_tokens", "_tf"), idf


def train_linear(train: DataFrame, weights: Dim | None = None, label_col: str = "label",
                 features_col: str = "features", max_iter: int = 100, reg: float = 0.0, sparse: bool = False):
    """Multinomial logistic regression, optionally weighted per class (D10). ``sparse`` (texts): the same
    steps by ``linear.fit_linear``, as the library's products over sparse rows take many times as long."""
    if sparse:
        if weights is not None:
            train = join_dim(train, weights, label_col, "left").fillna(0.0, ["weight"])
        return fit_linear(train, "weight" if weights is not None else None, label_col, features_col, max_iter, reg)
    lr = LogisticRegression(featuresCol=features_col, labelCol=label_col, family="multinomial",
                            maxIter=max_iter, regParam=reg)
    if weights is not None:
        train = join_dim(train, weights, label_col, "left").fillna(0.0, ["weight"])
        lr = lr.setWeightCol("weight")
    return lr.fit(train)


def train_mlp(train: DataFrame, layers: list[int], label_col: str = "label", features_col: str = "features",
              max_iter: int = 100, seed: int = 42, initial_weights=None):
    """Multilayer perceptron (sigmoid hidden layers, softmax output)."""
    mlp = MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col, layers=layers,
                                         maxIter=max_iter, seed=seed)
    if initial_weights is not None:
        mlp = mlp.setInitialWeights(initial_weights)
    return mlp.fit(train)


def predict(model, df: DataFrame, keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    out = model.transform(df)
    if isinstance(model, FocalModel | LinearModel):
        return out.select(*[c for c in keep if c in out.columns], "pred", softmax("z").alias("probability"))
    return out.select(*[c for c in keep if c in out.columns],
                      F.col("prediction").cast("int").alias("pred"),
                      vector_to_array(F.col("probability")).alias("probability"))


# --- I3: focal-loss linear head by distributed gradient descent ---------------

@dataclass
class FocalModel:
    weights: np.ndarray          # C x D
    bias: np.ndarray             # C
    history: list[tuple[int, float]] = field(default_factory=list)  # (step, mean loss)

    def scores(self, x_col: str = "embedding"):
        return linear_scores(x_col, self.weights.tolist(), self.bias.tolist())

    def transform(self, df: DataFrame, x_col: str = "embedding") -> DataFrame:
        return df.withColumn("z", self.scores(x_col)).withColumn("pred", argmax("z"))


def _focal_grad_fn(w_b, num_classes: int, dims: int, alpha: float, gamma: float, x_col: str, label_col: str):
    def grads(batches):
        w, b = w_b.value
        g_w = np.zeros((num_classes, dims))
        g_b = np.zeros(num_classes)
        loss, n = 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[x_col].to_numpy()).astype(np.float64)
            y = pdf[label_col].to_numpy().astype(np.int64)
            z = x @ w.T + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            u = p[np.arange(len(y)), y]
            logu = np.log(u + EPS)
            loss += float(np.sum(-alpha * (1 - u) ** gamma * logu))
            d_u = -alpha * (1 - u) ** gamma / (u + EPS)
            if gamma:  # at u = 1 a gamma below 1 would give 0 * inf
                d_u += alpha * gamma * np.maximum(1 - u, 1e-12) ** (gamma - 1) * logu
            onehot = np.zeros_like(p)
            onehot[np.arange(len(y)), y] = 1.0
            d_z = (d_u * u)[:, None] * (onehot - p)
            g_w += d_z.T @ x
            g_b += d_z.sum(axis=0)
            n += len(y)
        # One row per class (its gradient, its bias's) and one with loss sum and row count.
        rows = [*np.column_stack([g_w, g_b]).tolist(), [loss, float(n)]]
        yield pd.DataFrame({"c": np.arange(num_classes + 1, dtype=np.int32), "g": rows})
    return grads


def gradient_cells(train: DataFrame, weights: np.ndarray, bias: np.ndarray, alpha: float = FOCAL_ALPHA,
                   gamma: float = FOCAL_GAMMA, x_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(c, i, v): summed gradients of a linear head at these weights, cell by cell of C x (D + 1), and for
    c = C the sum of losses and the rows. Partitions sum their rows, the cluster adds the partitions' sums
    place by place in a hash aggregate: no group is held, and rows combine before the shuffle."""
    spark = train.sparkSession
    num_classes, dims = weights.shape
    w_b = spark.sparkContext.broadcast((weights, bias))
    parts = train.select(x_col, label_col).mapInPandas(_focal_grad_fn(w_b, num_classes, dims, alpha, gamma, x_col, label_col), "c int, g array<double>")
    return parts.select("c", F.posexplode("g").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))


def focal_gradient(train: DataFrame, weights: np.ndarray, bias: np.ndarray, **kwargs) -> DataFrame:
    """(c, g): the cells of ``gradient_cells`` as one array per class."""
    cells = gradient_cells(train, weights, bias, **kwargs)
    return cells.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g"))


def train_focal(train: DataFrame, num_classes: int, dims: int, steps: int = 30, lr: float = 2.0,
                alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, x_col: str = "embedding",
                label_col: str = "label", init: FocalModel | None = None, cache: bool = True) -> FocalModel:
    """Full-batch gradient descent on the focal loss. ``cache=False`` when
    the caller already keeps ``train`` across calls."""
    data = train.select(x_col, label_col)
    if cache:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    w = init.weights.copy() if init is not None else np.zeros((num_classes, dims))
    b = init.bias.copy() if init is not None else np.zeros(num_classes)
    history = []
    try:
        for step in range(steps):
            g = np.zeros((num_classes, dims + 1))
            loss, n = 0.0, 0.0
            for c, i, v in gradient_cells(data, w, b, alpha, gamma, x_col, label_col).collect():
                if c < num_classes:
                    g[c, i] = v
                elif i == 0:
                    loss = v
                else:
                    n = v
            n = max(n, 1.0)
            history.append((step, float(loss) / n))
            w = w - lr * g[:, :dims] / n
            b = b - lr * g[:, dims] / n
    finally:
        if cache:
            data.unpersist()
    return FocalModel(w, b, history)


MODELS = {
    "linear": train_linear,
    "mlp": train_mlp,
    "focal": train_focal,
}


def fit(name: str, train: DataFrame, **kwargs):
    """A classifier head by name."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; expected one of {sorted(MODELS)}")
    return MODELS[name](train, **kwargs)
