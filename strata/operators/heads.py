"""I1-I2, I7 and D14 as training jobs: classifier heads whose every step is one scan.

Each step broadcasts the parameters (their number is set by the head, not by the data), partitions
return sums over their rows as one flat vector, and a hash aggregate adds the vectors place by
place; the driver gets one number a place. Rows stay where they are.

* ``fit_convex``: softmax regression to convergence by L-BFGS; a line search tries several
  step sizes in one scan.
* ``fit_relu``: layers of (dropout, linear, normalization, ReLU) by back-propagation; batch
  moments are sums over all rows, and dropout masks are md5 draws by row, so a retried task repeats them.
* ``cross_validate``: the heads of all folds and parameters as one stacked weight matrix.
* ``fit_batches``: mini-batch steps in the order of exact batches under the loss weighted by each
  batch's label counts; shards of whole batches run side by side and are averaged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from strata.functions.hashing import draw
from strata.operators.losses import EPS, ICE_SCALE
from strata.operators.permute import exact_batches

Rows = tuple[np.ndarray, np.ndarray, list]


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def summed(df: DataFrame, fn: Callable[[Iterator[Rows]], np.ndarray], size: int, x_col: str, label_col: str, extra: str | None = None) -> np.ndarray:
    """The sum over partitions of ``fn`` of a partition's (x, label, extra) batches, a vector of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((_matrix(b.column(0)), np.asarray(b.column(1)).astype(np.int64), b.column(2).to_pylist() if extra else []) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([fn(rows).tolist()], pa.list_(pa.float64()))], names=["g"])

    cols = [F.col(x_col).cast("array<double>"), F.col(label_col).cast("int"), *([F.col(extra)] if extra else [])]
    parts = df.select(*cols).mapInArrow(run, "g array<double>")
    out = np.zeros(size)
    for i, v in parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


# --- I1: softmax regression to convergence -----------------------------------------------

#: Step sizes of a line search, all tried in one scan.
STEP_SIZES = (1.0, 2.0, 0.5, 0.25, 0.1, 0.01)


@dataclass
class ConvexFit:
    weights: np.ndarray  # C x (D + 1), the bias last
    steps: int
    gradient: float      # largest entry left


def fit_convex(train: DataFrame, num_classes: int, dims: int, l2: float = 0.01, tol: float = 1e-10, max_steps: int = 500, memory: int = 10,
               x_col: str = "embedding", label_col: str = "label") -> ConvexFit:
    """Mean cross entropy + l2/2 |W|^2 (the bias included, so the minimum is one point), minimized until no
    entry of the gradient exceeds ``tol``; raises where ``max_steps`` scans are not enough."""
    shape, cells = (num_classes, dims + 1), num_classes * (dims + 1)
    data = train.select(x_col, label_col).persist(StorageLevel.MEMORY_AND_DISK)

    def at(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Value and gradient at several points, in one scan."""
        stacked = np.stack(points)

        def part(rows: Iterator[Rows]) -> np.ndarray:
            loss, grad, n = np.zeros(len(stacked)), np.zeros((len(stacked), *shape)), 0
            for x, y, _ in rows:
                x = _with_one(x)
                for k, w in enumerate(stacked):
                    p = _probabilities(x @ w.T)
                    loss[k] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                    p[np.arange(len(y)), y] -= 1
                    grad[k] += p.T @ x
                n += len(y)
            return np.concatenate([[n], loss, grad.ravel()])

        got = summed(data, part, 1 + len(points) * (cells + 1), x_col, label_col)
        n, loss, grad = max(got[0], 1), got[1 : 1 + len(points)], got[1 + len(points) :].reshape(-1, *shape)
        return [(loss[k] / n + l2 / 2 * (w**2).sum(), grad[k] / n + l2 * w) for k, w in enumerate(points)]

    try:
        w = np.zeros(shape)
        value, g = at([w])[0]
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, max_steps + 1):
            if np.abs(g).max() <= tol:
                return ConvexFit(w, step - 1, float(np.abs(g).max()))
            q, alphas = g.copy(), []
            for s, t in reversed(past):
                alphas.append((s * q).sum() / (s * t).sum())
                q -= alphas[-1] * t
            if past:
                s, t = past[-1]
                q *= (s * t).sum() / (t * t).sum()
            for (s, t), a in zip(past, reversed(alphas)):
                q += s * (a - (t * q).sum() / (s * t).sum())
            points = [w - size * q for size in STEP_SIZES]
            tried = at(points)
            # Near the minimum the values agree to the last digit and the gradients decide.
            best = min(range(len(points)), key=lambda k: (tried[k][0] > value + 1e-13 * abs(value), np.abs(tried[k][1]).max()))
            new_w, (value, new_g) = points[best], tried[best]
            if ((new_w - w) * (new_g - g)).sum() > 0:
                past = [*past, (new_w - w, new_g - g)][-memory:]
            w, g = new_w, new_g
    finally:
        data.unpersist()
    raise RuntimeError(f"no convergence in {max_steps} steps: gradient {np.abs(g).max():.3g}")


# --- I7: folds x parameters as one stacked matrix ------------------------------------------


def with_fold(df: DataFrame, folds: int, seed=42, id_col: str = "id") -> DataFrame:
    return df.withColumn("fold", F.pmod(draw(seed, F.col(id_col)), F.lit(folds)).cast("int"))


def cross_validate(df: DataFrame, num_classes: int, dims: int, l2s: list[float], folds: int = 5, steps: int = 30, lr: float = 2.0, seed=42,
                   id_col: str = "id", x_col: str = "embedding", label_col: str = "label") -> list[tuple[int, float, int, float, float]]:
    """(fold, l2, held-out rows, their mean loss, their accuracy): for every fold and l2 a head trained by
    full-batch steps on the other folds. One scan a step serves all; another scores them."""
    blocks = [(f, l2) for f in range(folds) for l2 in l2s]
    own = np.array([f for f, _ in blocks])
    reg = np.array([l2 for _, l2 in blocks])[:, None, None]
    w = np.zeros((len(blocks), num_classes, dims + 1))
    data = with_fold(df, folds, seed, id_col).select(x_col, label_col, "fold").persist(StorageLevel.MEMORY_AND_DISK)

    def scan(score: bool) -> np.ndarray:
        now = w

        def part(rows: Iterator[Rows]) -> np.ndarray:
            n, first, second = np.zeros(len(blocks)), np.zeros(len(blocks)), np.zeros((len(blocks), *now.shape[1:]) if not score else len(blocks))
            for x, y, fold in rows:
                x, out = _with_one(x), np.asarray(fold)[:, None] == own[None, :]
                p = _probabilities(np.einsum("nd,bcd->nbc", x, now))
                if score:
                    u = p[np.arange(len(y)), :, y]
                    first += np.where(out, -np.log(u + EPS), 0).sum(0)
                    second += (out & (p.argmax(2) == y[:, None])).sum(0)
                    n += out.sum(0)
                else:
                    p[np.arange(len(y)), :, y] -= 1
                    second += np.einsum("nbc,nd->bcd", np.where(out[:, :, None], 0.0, p), x)
                    n += (~out).sum(0)
            return np.concatenate([n, first, second.ravel()])

        size = 2 * len(blocks) + (len(blocks) if score else w.size)
        return summed(data, part, size, x_col, label_col, "fold")

    b = len(blocks)
    try:
        for _ in range(steps):
            got = scan(False)
            n = np.maximum(got[:b], 1)[:, None, None]
            w = w - lr * (got[2 * b :].reshape(w.shape) / n + reg * w)
        got = scan(True)
    finally:
        data.unpersist()
    n = got[:b]
    return [(f, l2, int(n[k]), float(got[b + k] / max(n[k], 1)), float(got[2 * b + k] / max(n[k], 1))) for k, (f, l2) in enumerate(blocks)]


# --- I2: layers of dropout, linear, normalization, ReLU -------------------------------------

NORM_EPS, MOMENTUM = 1e-5, 0.1


@dataclass
class ReluHead:
    """Layer l maps sizes[l] to sizes[l + 1]; all but the last are normalized (maybe) and rectified."""

    sizes: list[int]
    dropout: float = 0.0
    norm: str | None = None  # None, "batch" or "layer"
    seed: int = 42
    weights: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    shift: list[np.ndarray] = field(default_factory=list)
    running: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def __post_init__(self):
        if self.norm not in (None, "batch", "layer"):
            raise ValueError(f"unknown normalization {self.norm!r}; expected None, 'batch' or 'layer'")
        if not self.weights:
            for layer, (m, k) in enumerate(zip(self.sizes, self.sizes[1:])):
                self.weights.append(start_weights(self.seed, layer, m, k))
                self.bias.append(np.zeros(k))
            self.gain = [np.ones(k) for k in self.sizes[1:-1]]
            self.shift = [np.zeros(k) for k in self.sizes[1:-1]]
            self.running = [(np.zeros(k), np.ones(k)) for k in self.sizes[1:-1]]

    def mask(self, step: int, layer: int, ids: list, units: int) -> np.ndarray:
        """Dropout's factors: 0, or the inverse of the share kept. A unit falls out where its byte of
        md5('seed:step:layer:id:block') (16 units a block) is below 256 times the rate."""
        cut = int(self.dropout * 256)
        raw = b"".join(hashlib.md5(f"{self.seed}:{step}:{layer}:{i}:{b}".encode()).digest() for i in ids for b in range(-(-units // 16)))
        drawn = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)[:, :units]
        return (drawn >= cut) * (256 / (256 - cut))

    def _normal(self, layer: int, z: np.ndarray, moments: list) -> tuple[np.ndarray, np.ndarray]:
        """(z-hat, 1 / deviation) of a layer's sums."""
        if self.norm is None:
            return z, np.ones(1)
        mean, var = moments[layer] if self.norm == "batch" else (z.mean(1, keepdims=True), z.var(1, keepdims=True))
        inverse = 1 / np.sqrt(var + NORM_EPS)
        return (z - mean) * inverse, inverse

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Class scores of rows: no dropout, running moments."""
        a = x
        for layer in range(len(self.weights)):
            a = a @ self.weights[layer].T + self.bias[layer]
            if layer < len(self.gain):
                a = np.maximum(self._normal(layer, a, self.running)[0] * (self.gain[layer] if self.norm else 1) + (self.shift[layer] if self.norm else 0), 0)
        return a

    def transform(self, df: DataFrame, x_col: str = "embedding") -> DataFrame:
        """df + z (class scores), in Arrow batches; the parameters are broadcast."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        from pyspark.sql.types import ArrayType, DoubleType

        @F.arrow_udf(ArrayType(DoubleType()))
        def score(col: pa.Array) -> pa.Array:
            return pa.array(list(shared.value.scores(_matrix(col))) if len(col) else [], pa.list_(pa.float64()))

        return df.withColumn("z", score(F.col(x_col).cast("array<double>")))


def start_weights(seed, layer: int, m: int, k: int) -> np.ndarray:
    """Uniform in +-1 / sqrt(m), from md5('seed:layer:unit:input')."""
    u = [[int(hashlib.md5(f"{seed}:{layer}:{i}:{j}".encode()).hexdigest()[:12], 16) / 16**12 for j in range(m)] for i in range(k)]
    return (2 * np.array(u) - 1) / np.sqrt(m)


def _relu_part(head: ReluHead, step: int, moments: list, sums: list):
    """One scan's work: as far forward as batch moments are known, then as far back as their sums are.

    Vectors: [rows, sums of z and z^2] of the first layer without moments; or [rows, loss, then from the
    last layer down its weight and bias gradients, and, before each lower layer, the sums of dy and dy * z-hat
    of the normalization between], ending at the first normalization whose sums are not known."""
    last = len(head.weights) - 1

    def part(rows: Iterator[Rows]) -> np.ndarray:
        total: list[np.ndarray] | None = None
        for x, y, ids in rows:
            masks, inputs, hats, inverses, acts = [], [], [], [], []
            a, found = x, None
            for layer in range(last + 1):
                masks.append(head.mask(step, layer, ids, a.shape[1]) if head.dropout else np.ones(1))
                a = a * masks[-1]
                inputs.append(a)
                z = a @ head.weights[layer].T + head.bias[layer]
                if layer == last:
                    break
                if head.norm == "batch" and layer >= len(moments):
                    found = [np.array([len(y)]), z.sum(0), (z**2).sum(0)]
                    break
                hat, inverse = head._normal(layer, z, moments)
                out = hat * head.gain[layer] + head.shift[layer] if head.norm else hat
                hats.append(hat)
                inverses.append(inverse)
                acts.append(out)
                a = np.maximum(out, 0)
            if found is None:
                p = _probabilities(z)
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                p[np.arange(len(y)), y] -= 1
                found, dz = [np.array([len(y)]), np.array([loss])], p
                for layer in range(last, -1, -1):
                    found += [(dz.T @ inputs[layer]).ravel(), dz.sum(0)]
                    if layer == 0:
                        break
                    below = layer - 1
                    dy = (dz @ head.weights[layer]) * masks[layer] * (acts[below] > 0)
                    if head.norm is None:
                        dz = dy
                        continue
                    found += [dy.sum(0), (dy * hats[below]).sum(0)]
                    scaled = dy * head.gain[below]
                    if head.norm == "layer":
                        dz = inverses[below] * (scaled - scaled.mean(1, keepdims=True) - hats[below] * (scaled * hats[below]).mean(1, keepdims=True))
                    elif last - 1 - below < len(sums):
                        s1, s2, n = sums[last - 1 - below]
                        dz = inverses[below] * head.gain[below] * (dy - s1 / n - hats[below] * s2 / n)
                    else:
                        break
            total = found if total is None else [u + v for u, v in zip(total, found)]
        return np.concatenate(total) if total is not None else np.zeros(0)

    return part


def fit_relu(train: DataFrame, head: ReluHead, steps: int = 10, lr: float = 0.5, clip: float | None = None, id_col: str = "id",
             x_col: str = "embedding", label_col: str = "label") -> ReluHead:
    """``steps`` full-batch steps on the mean cross entropy, in place; rows' ids seed their dropout.
    ``clip`` bounds the norm of the whole gradient."""
    data = train.select(x_col, label_col, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    last = len(head.weights) - 1
    size = 2 + sum(w.size + 3 * len(w) for w in head.weights)
    try:
        for step in range(len(head.history), len(head.history) + steps):
            scan = lambda moments, sums: summed(data, _relu_part(head, step, moments, sums), size, x_col, label_col, id_col)  # noqa: B023, E731
            moments: list = []
            for layer in range(last if head.norm == "batch" else 0):
                got, k = scan(moments, []), head.sizes[layer + 1]
                n = max(got[0], 1)
                mean = got[1 : 1 + k] / n
                var = np.maximum(got[1 + k : 1 + 2 * k] / n - mean**2, 0)
                moments.append((mean, var))
                old = head.running[layer]
                head.running[layer] = ((1 - MOMENTUM) * old[0] + MOMENTUM * mean, (1 - MOMENTUM) * old[1] + MOMENTUM * var * n / max(n - 1, 1))
            sums: list = []
            while True:
                got = scan(moments, sums)
                n, at = max(got[0], 1), 2
                grads, new = [], []
                for layer in range(last, -1, -1):
                    w = head.weights[layer]
                    grads.append((layer, got[at : at + w.size].reshape(w.shape) / n, got[at + w.size : at + w.size + len(w)] / n))
                    at += w.size + len(w)
                    if layer and head.norm:
                        k = head.sizes[layer]
                        new.append((got[at : at + k], got[at + k : at + 2 * k], n))
                        at += 2 * k
                if head.norm != "batch" or len(sums) == last:
                    break
                sums = new[: len(sums) + 1]
            head.history.append(float(got[1] / n))
            flat = [g for _, gw, gb in grads for g in (gw, gb)] + [s / n for s1, s2, _ in new for s in (s1, s2)]
            scale = lr if clip is None else lr * min(1.0, clip / max(np.sqrt(sum((g**2).sum() for g in flat)), 1e-12))
            for (layer, gw, gb) in grads:
                head.weights[layer] = head.weights[layer] - scale * gw
                head.bias[layer] = head.bias[layer] - scale * gb
            for k, (s1, s2, _) in enumerate(new):
                below = last - 1 - k
                head.gain[below] = head.gain[below] - scale * s2 / n
                head.shift[below] = head.shift[below] - scale * s1 / n
    finally:
        data.unpersist()
    return head


# --- D14 as a training loss over exact batches -------------------------------------------


def batch_weights(labels: np.ndarray, num_classes: int, power: float = 1.0, scale: float = ICE_SCALE, present_only: bool = False) -> np.ndarray:
    """Per class, 1 / (count^power + eps) normalized to ``scale``, from one batch's labels."""
    count = np.bincount(labels, minlength=num_classes).astype(np.float64)
    inverse = 1 / (count**power + EPS)
    return inverse / (inverse[count > 0].sum() if present_only else inverse.sum()) * scale


def batch_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, lr: float, **weighting) -> tuple[np.ndarray, float]:
    """One step on a batch's mean loss: the weights after it and the loss before it."""
    x, own = _with_one(x), batch_weights(y, len(w), **weighting)[y]
    p = _probabilities(x @ w.T)
    u = p[np.arange(len(y)), y]
    loss = float((-own * np.log(u + EPS)).mean())
    p[np.arange(len(y)), y] -= 1
    return w - lr * ((p * (own * u / (u + EPS))[:, None]).T @ x) / len(y), loss


def fit_batches(train: DataFrame, num_classes: int, dims: int, epochs: int = 3, batch_size: int = 64, lr: float = 0.05, shard_batches: int = 256, seed=42,
                present_only: bool = True, power: float = 1.0, scale: float = ICE_SCALE, id_col: str = "id", x_col: str = "embedding", label_col: str = "label"
                ) -> tuple[np.ndarray, list[float]]:
    """(weights C x (D + 1), mean loss of each epoch). An epoch shuffles the rows into exact batches; a shard
    of ``shard_batches`` batches steps through them in order from the epoch's weights, and the
    shards' results are averaged by their batches. Shards are set by the rows, not by how Spark cuts them,
    and hold a set number of rows, so their number grows with the data."""
    w, losses = np.zeros((num_classes, dims + 1)), []
    weighting = {"present_only": present_only, "power": power, "scale": scale}
    spark = train.sparkSession
    for epoch in range(epochs):
        ordered = exact_batches(train.select(id_col, F.col(x_col).cast("array<double>").alias("x"), F.col(label_col).cast("int").alias("y")), batch_size, f"{seed}:{epoch}", id_col)
        shared = spark.sparkContext.broadcast(w)

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("position")
            now, x, y = shared.value.copy(), _matrix(t["x"].combine_chunks()), t["y"].to_numpy().astype(np.int64)
            batch = t["batch_id"].to_numpy()
            cuts, loss = np.flatnonzero(np.diff(batch, prepend=batch[0] - 1)), 0.0
            for s, e in zip(cuts, [*cuts[1:], len(y)]):
                now, at = batch_step(now, x[s:e], y[s:e], lr, **weighting)
                loss += at
            return pa.table({"g": pa.array([[float(len(cuts)), loss, *(now * len(cuts)).ravel().tolist()]], pa.list_(pa.float64()))})

        shards = ordered.select(F.expr(f"batch_id div {shard_batches}").alias("shard"), "batch_id", "position", "x", "y").groupBy("shard").applyInArrow(run, "g array<double>")
        got = np.zeros(2 + w.size)
        for i, v in shards.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[i] = v
        if got[0]:
            w = got[2:].reshape(w.shape) / got[0]
            losses.append(float(got[1] / got[0]))
    return w, losses
