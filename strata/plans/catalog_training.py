"""Registered queries of the training jobs and of exact batches (see ``catalog`` for the others)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import heads as H
from strata.operators import permute as P
from strata.plans import sqltext as Q
from strata.operators import registry as RG
from strata.operators import scoring as SC
from strata.operators import training as TR
from strata.plans.catalog import BATCH, C10, DIMS, EPOCHS, GAMMAS, PATIENCE, RUN_LR, SEED, SQL, _PARTS_SQL, codes, emb_parts, r6, register, stored_summary
from strata.session import persist_table, scratch_path
from strata.sources import delimited as DL
from strata.sources.tables import table
from strata.streaming import jobs as ST
from strata.streaming import stateful as SS


def rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding")


_ROWS = "e as materialized (select vec_id as id, cast(label as int) as label, cast(embedding as double[]) as x from embeddings)"


def near(c):
    """Six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- F4: exact batches ----------------------------------------------------------------------

_PLACED = f"""{Q.base_ctes()}, nr as (select id, row_number() over (order by id) - 1 as row_no, (select count(*) from dedup) as n from dedup),
placed as (select id, row_no, {Q.permuted('row_no', 'n', SEED, P.ROUNDS)} as position from nr)"""
_BATCHED = f"with {_PLACED} select id, cast(row_no as bigint) as row_no, position, position // {BATCH} as batch_id, position % {BATCH} as slot from placed"


@register("batches_exact", _BATCHED)
def q_batches_exact(spark, sf):
    """every batch but the last has exactly BATCH rows."""
    return P.exact_batches(codes(spark, sf).select("id"), BATCH, SEED).select("id", "row_no", "position", "batch_id", "slot")


@register("shuffled_export", _BATCHED)
def q_shuffled_export(spark, sf):
    """the shuffled rows written in their order, read back."""
    path = scratch_path(spark, "shuffled")
    P.shuffled_export(codes(spark, sf).select("id"), path, 64 * BATCH, BATCH, SEED)
    return spark.read.parquet(path).select("id", "row_no", "position", "batch_id", "slot")


# --- I1: a converged head -------------------------------------------------------------------

CONVEX_L2, TWIN_STEPS, TWIN_LR = 0.5, 24, 1.6


def _cells(w):
    return [(c, d, float(w[c, d])) for c in range(w.shape[0]) for d in range(w.shape[1])]


@register("train_convex", f"""with {_ROWS}, {Q.descent_ctes('cx', 'e', TWIN_STEPS, TWIN_LR, 0.0, eps=0.0, l2=CONVEX_L2)}
select cast(c as int) as cls, cast(d as int) as dim, round(case when d = {DIMS} then b[c + 1] else w[c + 1][d + 1] end, 6) + 0.0 as weight
from cx{TWIN_STEPS}, unnest(range(0, {C10})) as u(c), unnest(range(0, {DIMS} + 1)) as v(d)""")
def q_train_convex(spark, sf):
    """Softmax regression to convergence; the twin takes plain steps until nothing moves."""
    fit = H.fit_convex(rows(spark, sf), C10, DIMS, l2=CONVEX_L2)
    return spark.createDataFrame(_cells(fit.weights), "cls int, dim int, weight double").withColumn("weight", near(F.col("weight")))


# --- I7: cross-validation -------------------------------------------------------------------

FOLDS, GRID, CV_STEPS, CV_LR = 3, [0.0, 0.05], 3, 2.0


def _cv_sql() -> str:
    ctes, scores = [_ROWS, f"ef as materialized (select *, {Q.h(Q.lit(str(SEED)), 'id')} % {FOLDS} as fold from e)"], []
    for f in range(FOLDS):
        ctes.append(f"tr{f} as materialized (select * from ef where fold <> {f})")
        for k, l2 in enumerate(GRID):
            name = f"cv{f}_{k}_"
            ctes.append(Q.descent_ctes(name, f"tr{f}", CV_STEPS, CV_LR, 0.0, l2=l2))
            scores.append(f"select {f} as fold, {Q.lit(l2)} as l2, count(*) as n, round(avg(-ln(p[label + 1] + 1e-9)), 6) as loss, round(avg(cast(list_position(p, list_max(p)) - 1 = label as int)), 6) as acc "
                          f"from (select label, {Q.softmax_of('z')} as p from (select label, {Q.scores_of('x', 'w', C10, 1.0, 'b')} as z from ef, {name}{CV_STEPS} where fold = {f}))")
    return f"with {', '.join(ctes)} " + " union all ".join(scores)


@register("cross_validate", _cv_sql())
def q_cross_validate(spark, sf):
    """All folds and parameters as one stacked matrix, one scan a step."""
    got = H.cross_validate(rows(spark, sf), C10, DIMS, GRID, FOLDS, CV_STEPS, CV_LR, SEED)
    out = spark.createDataFrame(got, "fold int, l2 double, n long, loss double, acc double")
    return out.withColumns({"loss": near(F.col("loss")), "acc": near(F.col("acc"))})


# --- I2: the multi-layer head ---------------------------------------------------------------

RELU_HIDDEN, RELU_STEPS, RELU_LR, RELU_DROPOUT = 8, 2, 0.5, 0.25


def _relu_sql() -> str:
    w1, w2 = H.start_weights(SEED, 0, DIMS, RELU_HIDDEN).tolist(), H.start_weights(SEED, 1, RELU_HIDDEN, C10).tolist()
    start = {"w1": w1, "b1": [0.0] * RELU_HIDDEN, "gain": [1.0] * RELU_HIDDEN, "shift": [0.0] * RELU_HIDDEN, "w2": w2, "b2": [0.0] * C10}
    end = f"rl{RELU_STEPS}"
    grid = lambda name, m, k: f"select '{name}' as name, cast(i as int) as i, cast(j as int) as j, round({name}[i + 1][j + 1], 6) + 0.0 as value from {end}, unnest(range(0, {m})) as u(i), unnest(range(0, {k})) as v(j)"
    line = lambda name, m: f"select '{name}', cast(i as int), 0, round({name}[i + 1], 6) + 0.0 from {end}, unnest(range(0, {m})) as u(i)"
    parts = [grid("w1", RELU_HIDDEN, DIMS), grid("w2", C10, RELU_HIDDEN), *(line(n, RELU_HIDDEN) for n in ("b1", "gain", "shift")), line("b2", C10)]
    ctes = Q.relu_ctes("rl", "e", start, RELU_STEPS, RELU_LR, RELU_DROPOUT, SEED, DIMS, RELU_HIDDEN, C10)
    return f"with {_ROWS}, {ctes} " + " union all ".join(parts)


@register("train_relu", _relu_sql())
def q_train_relu(spark, sf):
    """Dropout, linear, batch normalization, ReLU, dropout, linear; the parameters after two steps."""
    head = H.ReluHead([DIMS, RELU_HIDDEN, C10], dropout=RELU_DROPOUT, norm="batch", seed=SEED)
    H.fit_relu(rows(spark, sf), head, RELU_STEPS, RELU_LR)
    out = [(name, i, j, float(v)) for name, m in (("w1", head.weights[0]), ("w2", head.weights[1])) for i, r in enumerate(m) for j, v in enumerate(r)]
    out += [(name, i, 0, float(v)) for name, m in (("b1", head.bias[0]), ("gain", head.gain[0]), ("shift", head.shift[0]), ("b2", head.bias[1])) for i, v in enumerate(m)]
    return spark.createDataFrame(out, "name string, i int, j int, value double").withColumn("value", near(F.col("value")))


# --- D14 as a training loss -----------------------------------------------------------------

ICE_EPOCHS, ICE_ROWS = 2, 64


@register("train_ice")
def q_train_ice(spark, sf):
    """Mini-batch steps under the batch-weighted loss; SQL has no sequence of steps, tests hold it against a plain loop."""
    w, _ = H.fit_batches(rows(spark, sf), C10, DIMS, ICE_EPOCHS, ICE_ROWS, lr=0.01, seed=SEED)
    return spark.createDataFrame(_cells(w), "cls int, dim int, weight double")


# --- A8 + I5: an ensemble from stored experiments -------------------------------------------

_KEPT = sorted(GAMMAS)
_VERSIONS = {run: EPOCHS - k for k, run in enumerate(_KEPT)}


@register("ensemble_registry", f"""with {_PARTS_SQL}, {", ".join(Q.descent_ctes(r, "tr", EPOCHS, RUN_LR, g) for r, g in GAMMAS.items())},
hm as ({" union all ".join(f"select '{r}' as run_id, w, b from {r}{v}" for r, v in _VERSIONS.items())}),
mp as (select id, label, {Q.softmax_of('z')} as p from (select e.*, {Q.scores_of('x', 'w', C10, 1.0, 'b')} as z from e, hm)),
pm as (select id, label, cls, avg(p[cls + 1]) as pmean from mp, unnest(range(0, {C10})) as u(cls) group by id, label, cls)
select id, label, cast(arg_min(cls, struct_pack(a := -pmean, b := cls)) as int) as pred, round(max(pmean), 6) as p from pm group by id, label""")
def q_ensemble_registry(spark, sf):
    """Train runs, store a head per epoch, choose versions in a registry of JSON documents, load its members, vote."""
    parts = emb_parts(spark, sf)
    train = persist_table(parts.filter("part = 'train'").select("embedding", "label"), "registry-train")
    heads, configs = scratch_path(spark, "heads"), scratch_path(spark, "registry")
    for run, gamma in GAMMAS.items():
        model = None
        for version in range(1, EPOCHS + 1):
            model = TR.train_focal(train, C10, DIMS, steps=1, lr=RUN_LR, gamma=gamma, init=model, cache=False)
            if version >= EPOCHS - len(GAMMAS):
                RG.save_head(spark, heads, run, version, model.weights, model.bias)
    entries = [(run, _VERSIONS[run], True, PATIENCE) for run in _KEPT] + [("dropped", 1, False, PATIENCE)]
    DL.write_indented_json(spark.createDataFrame(entries, "run_id string, version int, member boolean, patience int"), configs, "run_id")
    registry = DL.read_table_json(spark, configs, schema="version int, member boolean, patience int, run_id string", multi_line=True)
    probs = RG.ensemble_probs("embedding", RG.load_members(registry, heads), shard=1)
    pred, p = SC.vote_soft("probs", C10)
    return parts.select("id", "label", probs.alias("probs")).select("id", "label", pred.alias("pred"), r6(p).alias("p"))


# --- E4, J3: state of one's own -------------------------------------------------------------

@register("stream_early_stop", SQL["early_stop"])
def q_stream_early_stop(spark, sf):
    """E4 followed as a stream; the epochs of a run come in files of no order."""
    path = scratch_path(spark, "epochs")
    stored_summary(spark, sf).select("run_id", "epoch", "valid_loss").repartition(4, F.xxhash64("run_id", "epoch")).write.parquet(path)
    out = SS.run_stateful(SS.early_stop_stream(ST.read_stream(spark, path, files_per_batch=2), PATIENCE), "early-stop")
    return out.select("run_id", F.col("epoch").cast("int").alias("epoch"), "improved", "patience", "stop")


@register("stream_dedup_bounded", "select distinct user_id, event_type, date_trunc('day', ts)::timestamp as window_start from events")
def q_stream_dedup_bounded(spark, sf):
    """J3 with a watermark: keys once a day of event time; late rows are settled from the sink."""
    keys = ["user_id", "event_type"]
    events = ST.read_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    return SS.settled(SS.run_stateful(SS.dedup_bounded(events, keys, "ts"), "dedup-bounded"), keys).select(*keys, SS.OPENED)
