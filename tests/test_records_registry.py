"""Splittable multi-line files, tables that a rerun replaces, ensembles from stored heads, special tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import features as FT
from strata.operators import registry as RG
from strata.operators import runs as RN
from strata.sources import delimited as DL
from strata.sources import records as RC

SCHEMA = "id long, digit_1 string, digit_2 int, digit_3 int, text_obj string, text_mthd string, text_deal string"


def cells(i):
    return (i, "A", i, None if i % 5 == 0 else 3, ["plain", "two\nlines", 'a "quoted" b', "tail\n\n\nend", "똠방각하\n|", ""][i % 6],
            ["x|y", '"', "\n", ""][i % 4], "long\ncell " * (200 if i == 17 else 1))


def one_file(spark, rows, path, encoding, tmp):
    folder = str(tmp / f"w{path.name}")
    DL.write_delimited(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, encoding=encoding)
    part = next((tmp / f"w{path.name}").glob("part-*"))
    path.write_bytes(part.read_bytes())


def expected(rows):
    return sorted((*r[:4], *(t or "" for t in r[4:])) for r in rows)


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_files_of_both_charsets_in_many_splits(spark, tmp_path, split):
    (tmp_path / "in").mkdir()
    rows = [cells(i) for i in range(90)]
    one_file(spark, rows[:50], tmp_path / "in" / "a.csv", "cp949", tmp_path)
    one_file(spark, rows[50:], tmp_path / "in" / "b.csv", "UTF-8", tmp_path)
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        if split < 1000:
            assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 5
        got = RC.read_records(spark, str(tmp_path / "in")).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == expected(rows)


def test_records_with_carriage_returns_bad_cells_and_an_open_quote(spark, tmp_path):
    head = "id|digit_1|digit_2|digit_3|text_obj|text_mthd|text_deal\r\n"
    (tmp_path / "a.csv").write_bytes((head + '1|A|1|2|"x\r\ny"|b|c\r\n\r\n2|A|no|2|a|b|c\r\n3|A|1|2|a|b|"open\r\nend').encode())
    got = RC.read_records(spark, str(tmp_path / "a.csv"), bad_col="_bad").orderBy("id").collect()
    assert [(r.id, r.digit_2) for r in got] == [(1, 1), (2, None), (3, 1)]
    assert got[0].text_obj.replace("\r", "") == "x\ny" and got[0].text_deal == "c" and got[1]._bad == "2|A|no|2|a|b|c" and "end" in got[2].text_deal
    (tmp_path / "none.csv").write_text(head)
    assert RC.read_records(spark, str(tmp_path / "none.csv")).count() == 0


def test_a_rerun_replaces_its_epochs_and_a_killed_one_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda run, epoch, v: spark.createDataFrame([(run, epoch, v)], "run_id string, epoch int, loss double")
    for epoch in range(3):
        RN.append_summary(row("a", epoch, float(epoch)), path)
    RN.append_summary(row("b", 0, 9.0), path)
    # Killed between its rows and its commit: files that nothing names.
    row("a", 3, 99.0).withColumn("_part", F.lit("dead")).write.parquet(f"{path}/rows/dead")
    for epoch in range(1, 4):  # the rerun goes on from epoch 1
        RN.append_summary(row("a", epoch, 10.0 + epoch), path)
    got = sorted((r.run_id, r.epoch, r.loss) for r in RN.read_summary(spark, path).collect())
    assert got == [("a", 0, 0.0), ("a", 1, 11.0), ("a", 2, 12.0), ("a", 3, 13.0), ("b", 0, 9.0)]
    assert RN.read_summary(spark, path).columns.count("epoch") == 1 and "_part" not in RN.read_summary(spark, path).columns


def test_members_come_from_the_registry_and_are_scored_in_shards(spark, tmp_path):
    rng, path = np.random.default_rng(0), str(tmp_path / "heads")
    heads = {(run, v): (rng.normal(size=(3, 4)), rng.normal(size=3)) for run in "abc" for v in (1, 2)}
    for (run, v), (w, b) in heads.items():
        RG.save_head(spark, path, run, v, w, b)
    RG.save_head(spark, path, "a", 2, heads[("a", 2)][0] * 2, heads[("a", 2)][1])  # stored again: replaced
    registry = spark.createDataFrame([("c", 1, True), ("a", 2, True), ("b", 1, False)], "run_id string, version int, member boolean")
    members = RG.load_members(registry, path)
    assert [run for run, _, _ in members] == ["a", "c"]
    assert np.allclose(members[0][1], heads[("a", 2)][0] * 2) and np.allclose(members[1][1], heads[("c", 1)][0])
    x = rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for shard in (1, 2, 8):
        got = np.array([r.p for r in df.select("id", RG.ensemble_probs("x", members, shard).alias("p")).orderBy("id").collect()])
        for m, (_, w, b) in enumerate(members):
            z = np.exp(x @ w.T + b)
            assert np.allclose(got[:, m], z / z.sum(1, keepdims=True))
    with pytest.raises(ValueError):
        RG.load_members(spark.createDataFrame([("z", 1, True)], "run_id string, version int, member boolean"), path)


def test_two_texts_with_special_tokens_and_types(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "id long, text string")
    voc = FT.vocab(docs)  # a 2, b 3, c 4; two more in a sequence with special tokens
    rows = [(1, "a b", "c zz"), (2, "", "a"), (3, "a a a a a a a a", "b"), (4, None, None), (5, "b", "")]
    got = {r.id: r for r in FT.encode_pair(spark.createDataFrame(rows, "id long, x string, y string"), voc, "x", "y", max_len=8).collect()}
    want = {1: ([2, 4, 5, 3, 6, 1, 3, 0], [0, 0, 0, 0, 1, 1, 1, 0], 7), 2: ([2, 3, 4, 3, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0, 0, 0], 4),
            3: ([2, 4, 4, 4, 4, 4, 3, 0], [0] * 8, 7), 4: ([2, 3, 0, 0, 0, 0, 0, 0], [0] * 8, 2), 5: ([2, 5, 3, 0, 0, 0, 0, 0], [0] * 8, 3)}
    for i, (ids, types, n) in want.items():
        assert (list(got[i].input_ids), list(got[i].token_type_ids), got[i].valid_length) == (ids, types, n), i
        assert list(got[i].attention_mask) == [1] * n + [0] * (8 - n)
