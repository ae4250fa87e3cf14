"""The pipeline: each stage against its operator or brute force on the stage's own input."""

import corpus_pipeline as cp
from fixtures_llm import odd
from pyspark.sql import functions as F
from test_llm_bpe_packing import _check
from test_llm_dedup import brute_near, brute_repeats
from test_llm_quality import brute

import __spark_entry__ as E
from strata.session import persist_table
from strata.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_are_the_dealt_ones_and_registered():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    q = E.queries()
    assert q["pipeline"] is cp.run
    assert sorted(int(n[2:].split("_")[0]) for n in q if n.startswith("op")) == list(range(1, 14))


def test_every_stage_on_its_predecessors_output(spark):
    """One pass over documents with odd rows among them; each stage's decisions against its input."""
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    extra = odd(spark).filter("doc_id is not null").select((F.col("doc_id") + 100_000).alias("doc_id"), *columns[1:])
    before = docs.unionByName(extra)
    for name, stage in cp.STAGES:
        after = persist_table(stage(spark, before, SMALL), "test-pipeline")
        was, now = texts(before), texts(after) if name != "best_fit_packing" else None
        if name == "quality_rules":
            failed = {i for i, t in was if (w := brute(t))[0] < 10 or 100 * w[4] > 20 * w[0]}
            assert not failed & {i for i, _ in now} and set(now) <= set(was)
            good = {r.doc_id for r in table(spark, SMALL, "labels").filter("quality = 1").collect()}
            assert all((i, t) in set(now) for i, t in was if i in good and i not in failed)
        elif name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
            kept = {i for i, _ in now}
            right = [(i in kept) == (labels[i] == 1) for i, _ in was if i in labels]
            assert set(now) <= set(was) and sum(right) >= 0.95 * len(right)
        elif name == "minhash_near_dedup":
            groups = brute_near(was)
            assert sorted(i for i, _ in now) == sorted(i for i, _ in was if groups[i][2])
        elif name == "suffix_dedup":
            want = {i: x.decode("utf-8", "ignore") for i, (_, _, x) in brute_repeats(was).items()}
            assert dict(now) == want and all(r.n_chars == len(r.text) for r in after.collect())
        else:
            _check(after.collect(), was)
            break
        assert after.columns == columns
        before = after


def test_empty_tables_give_no_pieces(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
