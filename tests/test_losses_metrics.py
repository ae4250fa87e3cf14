import math

from pyspark.sql import functions as F

from strata.functions import arrays as A
from strata.operators import losses as LS
from strata.operators import metrics as M
from strata.operators.dims import bounded


def _z(spark):
    rows = [(0, 0, [2.0, 1.0, 0.1]), (1, 1, [0.5, 0.5, 3.0]), (2, 2, [1.0, 1.0, 1.0]), (3, 0, [5.0, 5.0, -1.0])]
    return spark.createDataFrame(rows, "id long, label int, z array<double>")


def test_softmax_and_argmax_ties(spark):
    r = _z(spark).select(A.softmax("z").alias("p"), A.argmax("z").alias("a")).collect()
    assert all(abs(sum(x.p) - 1) < 1e-12 for x in r)
    assert [x.a for x in r] == [0, 2, 0, 0]


def test_focal_gamma_zero_is_ce(spark):
    z = _z(spark)
    ce = LS.row_loss(z, "CE").agg(F.avg("loss")).first()[0]
    fo = LS.row_loss(z, "FCE", gamma=0.0).agg(F.avg("loss")).first()[0]
    assert abs(ce - fo) < 1e-12
    total = LS.reduce(LS.row_loss(z, "CE"), "sum").first()[0]
    assert abs(total - 4 * ce) < 1e-9


def test_unit_weights_and_ignore_index(spark):
    z = _z(spark)
    ones = bounded(spark.createDataFrame([(c, 1.0) for c in range(3)], "label int, weight double"), 3)
    a = LS.row_loss(z, "CE").agg(F.avg("loss")).first()[0]
    b = LS.row_loss(z, "CE", weights=ones).agg(F.avg("loss")).first()[0]
    assert abs(a - b) < 1e-12
    ig = LS.row_loss(z, "CE", ignore_index=0).filter("label = 0").agg(F.max("loss")).first()[0]
    assert ig == 0.0


def test_ice_absent_class_weights(spark):
    rows = [(i, 0 if i < 5 else 1, 0, [1.0, 0.0, 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label int, batch_id int, z array<double>")
    out = LS.ice_row_loss(df, num_classes=3).select("id", "label", "loss").collect()
    p0 = math.exp(1) / (math.exp(1) + 2)
    w = (1 / (5 + 1e-9)) / (2 / (5 + 1e-9) + 1e9) * 225
    assert abs(next(r.loss for r in out if r.label == 0) - w * -math.log(p0 + 1e-9)) < 1e-15


def test_scores_absent_classes_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (7, 1)], "label int, pred int")
    conf = M.confusion(df, 4)
    assert conf.agg(F.sum("n")).first()[0] == 3
    s = {r.class_id: r for r in M.class_scores(conf, 4).collect()}
    assert s[2].precision == s[2].recall == s[2].f1score == 0.0
    assert abs(s[1].precision - 0.5) < 1e-12 and s[1].recall == 1.0
    summ = M.summary(conf, 4).first()
    assert abs(summ.acc - 2 / 3) < 1e-12
    assert abs(summ.macro_rc - (0.5 + 1.0) / 4) < 1e-12


def test_ice_present_only_ignores_absent_classes(spark):
    rows = [(i, 0 if i < 5 else 1, 0, [1.0, 0.0, 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label int, batch_id int, z array<double>")
    out = {r.label: r.loss for r in LS.ice_row_loss(df, num_classes=3, present_only=True).collect()}
    p0 = math.exp(1) / (math.exp(1) + 2)
    assert abs(out[0] - 112.5 * -math.log(p0 + 1e-9)) < 1e-6


def test_evaluate_plan_matches_the_operators(spark):
    from strata.plans.evaluate import evaluate
    z = _z(spark)
    ev = evaluate(z, 3)
    s = ev.summary.first()
    ce = LS.row_loss(z, "CE").agg(F.avg("loss")).first()[0]
    assert abs(s.loss - ce) < 1e-12 and abs(s.acc - 0.5) < 1e-12
    grouped = evaluate(z.withColumn("part", F.lit("valid")), 3, by=["part"])
    g = grouped.summary.first()
    assert g.part == "valid" and abs(g.loss - ce) < 1e-12 and abs(g.macro_f1 - s.macro_f1) < 1e-12
    assert grouped.classes.count() == 3
