"""Linear scoring, ensemble stacks, votes and the prediction export.

Scores are per row (no explode, no shuffle); a weight matrix is a model
parameter of bounded size (C x D) applied to Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strata.functions.arrays import argmax, softmax
from strata.operators.dims import Dim, join_dim

def rule_weights(num_classes: int, dims: int, rule) -> list[list[float]]:
    return [[float(rule(c, d)) for d in range(dims)] for c in range(num_classes)]


def linear_scores(x: str | Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """z[c] = sum_d w[c][d] * x[d] (+ b[c]) as ARRAY<DOUBLE>; NULL for a NULL vector.

    The matrix travels once with an Arrow batch function (one product per batch), so plans do not
    grow with C x D.
    """
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.arrow_udf(ArrayType(DoubleType()))
    def score(a: pa.Array) -> pa.Array:
        known = np.asarray(a.is_valid())
        z = np.asarray(a.drop_null().flatten(), dtype=np.float64).reshape(-1, w.shape[1]) @ w.T + b
        ends = np.concatenate([[0], np.cumsum(known) * len(w)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()), mask=pa.array(~known))

    return score(F.col(x) if isinstance(x, str) else x)


def stacked_scores(x: str | Column, heads: Sequence[Sequence[Sequence[float]]], biases: Sequence[Sequence[float]] | None = None) -> Column:
    """ARRAY<ARRAY<DOUBLE>> [head][class]: several heads over the whole vector, in one product."""
    c = len(heads[0])
    flat = linear_scores(x, [row for h in heads for row in h], None if biases is None else [v for b in biases for v in b])
    return F.zip_with(F.sequence(F.lit(0), F.lit(len(heads) - 1)), F.array_repeat(flat, len(heads)), lambda m, z: F.slice(z, m * c + 1, c))


def member_probs(x: str | Column, heads: Sequence[Sequence[Sequence[float]]]) -> Column:
    """The softmax of every member's scores; ARRAY<ARRAY<DOUBLE>> [M][C]."""
    return F.transform(stacked_scores(x, heads), lambda z: softmax(z))


def vote_hard(probs: str | Column, num_classes: int) -> tuple[Column, Column]:
    """Each member votes for its argmax; (winning class, its vote count),
    lowest class on ties."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    picks = F.transform(probs, lambda p: argmax(p))
    votes = F.zip_with(F.sequence(F.lit(0), F.lit(num_classes - 1)), F.array_repeat(picks, num_classes),
                       lambda c, ps: F.size(F.filter(ps, lambda p: p == c)))
    return argmax(votes.cast("array<double>")), F.array_max(votes)


def mean_probs(probs: str | Column, num_classes: int) -> Column:
    """The members' mean probability of each class."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    return F.zip_with(F.sequence(F.lit(0), F.lit(num_classes - 1)), F.array_repeat(probs, num_classes),
                      lambda c, ps: F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.element_at(p, c + 1)) / F.size(ps))


def vote_soft(probs: str | Column, num_classes: int) -> tuple[Column, Column]:
    """Mean probability over members; (argmax class, its mean probability)."""
    mean = mean_probs(probs, num_classes)
    return argmax(mean), F.array_max(mean)


def one_hot_votes(probs: str | Column, num_classes: int) -> Column:
    """The reference's vote matrix: per member, one-hot of its argmax; [M][C] ints."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    return F.transform(probs, lambda p: F.zip_with(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                                                   F.array_repeat(argmax(p), num_classes),
                                                   lambda c, a: (c == a).cast("int")))


def predictions_export(df: DataFrame, label_map: Dim, text_col: str = "text", label_col: str = "label",
                       pred_col: str = "pred", path: str | None = None, sep: str = ",",
                       encoding: str = "UTF-8") -> DataFrame:
    """A4: (doc, category, predictions) with both ids mapped back to codes."""
    lm = label_map.df.select(F.col("label").alias("_l"), F.col("digit").alias("_d"))
    m = Dim(lm, label_map.rows, label_map.max_rows)
    out = join_dim(df, Dim(m.df.withColumnRenamed("_l", label_col).withColumnRenamed("_d", "category"), m.rows), label_col, "left")
    out = join_dim(out, Dim(m.df.withColumnRenamed("_l", pred_col).withColumnRenamed("_d", "predictions"), m.rows), pred_col, "left")
    out = out.select(F.col(text_col).alias("doc"), "category", "predictions", *[c for c in ("id",) if c in df.columns])
    if path:
        out.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return out


def model_udf(make_predict_fn, num_classes: int, dims: int, batch_size: int = 1024):
    """I4 hook: a user-supplied batch model (numpy in, numpy out) as an
    Arrow-batched ``predict_batch_udf`` returning ARRAY<DOUBLE> scores."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType
    return predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                             input_tensor_shapes=[[dims]])


def numpy_linear(weights: Sequence[Sequence[float]]):
    """A ``make_predict_fn`` for a fixed linear head (the model is built once per worker)."""
    def make():
        import numpy as np
        w = np.asarray(weights, dtype=np.float64)

        def predict(x):
            return np.asarray(x, dtype=np.float64) @ w.T
        return predict
    return make
