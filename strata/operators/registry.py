"""A8 + I5: an ensemble loaded from stored experiments.

Trained heads are rows of a table, one per (run, version, class). The registry, one record per run,
says which version of a run counts and whether it is a member. Loading joins the two; members are
scored in shards of a set number, so a plan carries a bounded matrix at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.arrays import softmax
from strata.operators.runs import append_rows, read_rows
from strata.operators.scoring import stacked_scores

#: Members scored in one product.
SHARD = 8

HEAD_KEYS = ("run_id", "version")


def save_head(spark: SparkSession, path: str, run_id: str, version: int, weights: np.ndarray, bias: np.ndarray) -> None:
    """Add a head to the table; the same run and version again replaces it."""
    rows = [(run_id, version, c, [float(v) for v in w], float(b)) for c, (w, b) in enumerate(zip(weights, bias))]
    append_rows(spark.createDataFrame(rows, "run_id string, version int, cls int, w array<double>, b double"), path, HEAD_KEYS)


def load_members(registry: DataFrame, path: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(run, weights C x D, bias) of the registry's members (run_id, version, member), in order of their runs.
    Only the chosen versions' parameters reach the driver. A member without a stored head raises."""
    spark = registry.sparkSession
    wanted = registry.filter("member").select(*HEAD_KEYS)
    rows = wanted.join(read_rows(spark, path, HEAD_KEYS), list(HEAD_KEYS), "left").orderBy("run_id", "cls").collect()
    missing = sorted({r.run_id for r in rows if r.cls is None})
    if missing:
        raise ValueError(f"no stored head for {missing}")
    runs = sorted({r.run_id for r in rows})
    return [(run, np.array([r.w for r in rows if r.run_id == run]), np.array([r.b for r in rows if r.run_id == run])) for run in runs]


def ensemble_probs(x: str, members: list[tuple[str, np.ndarray, np.ndarray]], shard: int = SHARD) -> Column:
    """[M][C] probabilities of all members, shard by shard."""
    parts = []
    for at in range(0, len(members), shard):
        some = members[at : at + shard]
        scores = stacked_scores(x, [w.tolist() for _, w, _ in some], [b.tolist() for _, _, b in some])
        parts.append(F.transform(scores, lambda z: softmax(z)))
    return F.concat(*parts)
