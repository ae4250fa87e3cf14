"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each document's statistics become a vector of variance-stabilised shares. Per
(language, source) a minimum-covariance-determinant estimate is found by concentration
steps: from deterministic starts, the h rows nearest to the current centre give the next
centre and covariance, and the start whose covariance has the least determinant wins;
a reweighting step follows. Documents whose Mahalanobis distance passes a chi-square
quantile are rejected.

Everything is aggregates over a table of vectors (no text): a step is a histogram of
distances per group, whose cumulated counts give the bucket that holds the h-th nearest
row (ties in a bucket stay together), and a sum of moments over the rows within it. Both
combine on the map side, so a source with a third of all rows costs a few rows a task.
Only the inverse of a group's small matrix is taken in Python.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.llm.stats import share, with_counts
from strata.session import persist_table

#: Base limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Rows a group needs for an estimate of its own; smaller ones use their language's, then the corpus's.
MIN_GROUP = 200
#: Share of a group's rows that the determinant is taken over.
SUPPORT = 0.6
STEPS = 3
#: A clean document fails the limit with probability 1e-4 under the normal model.
LEVEL = 0.9999
#: Least spread of each component: below it differences are of no interest, and a share
#: that is zero in most documents would make the matrix singular.
FLOORS = (0.10, 0.12, 0.12, 0.08, 0.08, 0.08)
P = len(FLOORS)
STARTS = ("spread", "half")
MAX_BROADCAST_MODELS = 100_000
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Distance histogram: buckets per doubling of the squared distance.
_FINE = 16


def chi_square(level: float, p: int = P) -> float:
    """The chi-square quantile with p degrees of freedom (Wilson-Hilferty)."""
    a = 2 / (9 * p)
    return p * (1 - a + NormalDist().inv_cdf(level) * math.sqrt(a)) ** 3


def vector(s: str = "_stats") -> list[Column]:
    """The transformed components: square roots of shares, logarithm of the mean word length."""
    c = lambda f: F.col(f"{s}.{f}")
    return [
        F.log((c("word_chars") + 50.0) / (c("n_words") + 10.0)),
        F.sqrt(share(c("n_symbols"), c("n_words"), 10)),
        F.sqrt(share(c("n_marks"), c("n_words"), 10)),
        F.sqrt(share(c("n_upper"), c("word_chars"), 50)),
        F.sqrt(share(c("n_repeat_words"), c("n_words"), 10)),
        F.sqrt(share(c("n_digits"), c("word_chars"), 50)),
    ]


def base_failed(s: str = "_stats") -> Column:
    n, r = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


_X = [f"x{i}" for i in range(P)]
_MODEL = "lang string, source string, start string, n long, logdet double, " + ", ".join(
    [f"m{i} double" for i in range(P)] + [f"q{i}_{j} double" for i, j in _PAIRS])


def _distance() -> Column:
    """(x - m)' Q (x - m) from columns of the vector and of the model."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    terms = [(1.0 if i == j else 2.0) * d[i] * d[j] * F.col(f"q{i}_{j}") for i, j in _PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _bucket(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * _FINE).cast("int")


def _solve(moments: DataFrame, scale: float = 1.0) -> DataFrame:
    """Sums per (lang, source, start) -> centre, inverse covariance (floored), log determinant."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                m = np.array([getattr(r, f"s{i}") for i in range(P)]) / r.w
                cov = np.zeros((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = getattr(r, f"s{i}_{j}") / r.w - m[i] * m[j]
                cov = cov * scale + np.diag(np.square(FLOORS))
                inv = np.linalg.inv(cov)
                out.append([r.lang, r.source, r.start, r.n, np.linalg.slogdet(cov)[1], *m, *(inv[i, j] for i, j in _PAIRS)])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MODEL.split(", ")])

    return moments.mapInPandas(run, _MODEL)


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "source", "start").agg(
        F.count("*").alias("w"), F.max("n").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS])


def _join(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with their group's model; broadcast only when the count of models allows it."""
    side = F.broadcast(models) if models.count() <= MAX_BROADCAST_MODELS else models
    return rows.join(side, ["lang", "source"])


def _cut(scored: DataFrame, rank: Column) -> DataFrame:
    """Per (lang, source, start) the bucket of squared distance that holds the row of that rank."""
    hist = scored.groupBy("lang", "source", "start", "b").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    w = Window.partitionBy("lang", "source", "start").orderBy("b")
    return (hist.withColumn("upto", F.sum("c").over(w)).filter(F.col("upto") >= rank)
            .groupBy("lang", "source", "start").agg(F.min("b").alias("cut")))


def fit(vectors: DataFrame, name: str = "mcd") -> DataFrame:
    """vectors (lang, source, x0..) -> one model per (lang, source) group of at least MIN_GROUP
    rows, per language (source null) and for all (both null).

    Null languages and sources form groups of their own, written as ''.
    """
    levels = F.array(F.struct("lang", "source"), F.struct("lang", F.lit("\x00all").alias("source")),
                     F.struct(F.lit("\x00all").alias("lang"), F.lit("\x00all").alias("source")))
    rows = vectors.select(F.explode(levels).alias("g"), *_X).select("g.*", *_X)
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).filter(
        (F.col("n") >= MIN_GROUP) | (F.col("lang") == "\x00all"))
    middle = rows.groupBy("lang", "source").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(_X)])
    sizes = persist_table(sizes.join(middle, ["lang", "source"]), f"{name}-sizes")
    rows = _join(rows, sizes)
    # Starts: absolute deviations from the medians give a diagonal matrix; and the half of
    # the rows nearest to the medians, each component counted in units of its floor.
    mad = rows.groupBy("lang", "source").agg(*[
        (F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000) * 1.4826).alias(f"d{i}") for i in range(P)])
    flat = [F.lit(1.0 / f**2) for f in FLOORS]
    spread = [1 / (F.col(f"d{i}") * F.col(f"d{i}") + FLOORS[i] ** 2) for i in range(P)]
    first = sizes.join(mad, ["lang", "source"])
    starts = None
    for start, diag in zip(STARTS, (spread, flat)):
        one = first.select("lang", "source", F.lit(start).alias("start"), "n", F.lit(0.0).alias("logdet"), *[f"m{i}" for i in range(P)],
                           *[(diag[i] if i == j else F.lit(0.0)).alias(f"q{i}_{j}") for i, j in _PAIRS])
        starts = one if starts is None else starts.union(one)
    models = persist_table(starts, name)
    bare = rows.select("lang", "source", *_X)
    for _ in range(STEPS):
        scored = _join(bare, models).withColumn("b", _bucket(_distance()))
        cut = _cut(scored, F.ceil(F.col("n") * SUPPORT))
        models = persist_table(_solve(_moments(scored.join(cut, ["lang", "source", "start"]).filter("b <= cut"))), name)
    best = models.groupBy("lang", "source").agg(F.min(F.struct("logdet", "start")).alias("best"))
    models = persist_table(models.join(best, ["lang", "source"]).filter("start = best.start").drop("best"), name)
    # Reweighting: distances are scaled so that their median is the chi-square median, and the
    # rows within the 97.5 % quantile give the final centre and covariance.
    scored = _join(bare, models).withColumn("d2", _distance()).withColumn("b", _bucket(F.col("d2")))
    mid = _cut(scored, F.ceil(F.col("n") * 0.5)).withColumn("scale", F.greatest(F.pow(F.lit(2.0), (F.col("cut") + 1) / _FINE) / chi_square(0.5), F.lit(1e-3)))
    near = scored.join(mid, ["lang", "source", "start"]).filter(F.col("d2") <= F.col("scale") * chi_square(0.975))
    return persist_table(_solve(_moments(near), 1.1), f"{name}-final")


def judge(stats: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with a _stats column -> the same rows with base_failed, distance and kept."""
    own = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source")])
    x = stats.select("*", own.alias("_own"), F.struct(*[v.alias(n) for v, n in zip(vector(), _X)]).alias("_x"))
    packed = models.select(F.array("lang", "source").alias("_g"), F.struct(*[f"m{i}" for i in range(P)], *[f"q{i}_{j}" for i, j in _PAIRS]).alias("_m"))
    n = packed.count()
    both = lambda k: F.broadcast(k) if n <= MAX_BROADCAST_MODELS else k
    x = x.join(both(packed.toDF("_own", "_m1")), "_own", "left")
    x = x.withColumn("_k", F.array(F.col("_own")[0], F.lit("\x00all"))).join(both(packed.toDF("_k", "_m2")), "_k", "left").drop("_k")
    # The corpus's model is one value.
    x = x.withColumn("_m3", packed.filter(F.col("_g")[0] == "\x00all").select("_m").scalar())
    x = x.withColumn("_m", F.coalesce("_m1", "_m2", "_m3"))
    d = [F.col(f"_x.x{i}") - F.col(f"_m.m{i}") for i in range(P)]
    terms = [(1.0 if i == j else 2.0) * d[i] * d[j] * F.col(f"_m.q{i}_{j}") for i, j in _PAIRS]
    x = x.withColumn("distance", F.coalesce(F.sqrt(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))), F.lit(0.0)))
    x = x.withColumn("base_failed", base_failed())
    limit = math.sqrt(chi_square(LEVEL))
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit)).drop("_own", "_x", "_m", "_m1", "_m2", "_m3")


def vectors_of(stats: DataFrame) -> DataFrame:
    """Vectors of the documents that pass the base limits: what the estimates are fitted on."""
    g = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return stats.filter(~base_failed()).select(*g, *[v.alias(n) for v, n in zip(vector(), _X)])


def quality_rules(docs: DataFrame, name: str = "mcd") -> DataFrame:
    """documents (doc_id, text, lang, source, ...) -> doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, distance, kept; a row per input row.

    A null text has no words and fails the base limits, as does an empty one. Null languages
    and sources count as ''. With no row to fit on (an empty table), only base limits apply.
    """
    bare = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"))
    stats = persist_table(with_counts(bare).drop("text"), f"{name}-stats")
    out = judge(stats, fit(vectors_of(stats), name))
    return out.select("doc_id", *[F.col(f"_stats.{f}").alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, name: str = "mcd-stage") -> DataFrame:
    """The documents that the rules keep, with their columns as they were. The counts are
    taken again over the texts instead of shuffling the texts to the decisions."""
    bare = docs.select("text", "lang", "source")
    stats = persist_table(with_counts(bare).drop("text"), f"{name}-stats")
    # Columns go by place, so that no name clashes and a text is held once beside the Python stage.
    names, place = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    of = dict(zip(names, place))
    row = docs.toDF(*place).select("*", *[F.col(of[c]).cast("string").alias(c) for c in ("lang", "source")])
    kept = judge(with_counts(row, of["text"]), fit(vectors_of(stats), name)).filter("kept")
    return kept.select(*[F.col(p).alias(n) for n, p in zip(names, place)])
