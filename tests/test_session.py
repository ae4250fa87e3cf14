import os

from pyspark.sql import functions as F

from strata.operators import bootstrap as B
from strata.session import configure_for, persist_table, scratch_path


def test_configure_for_sizes_shuffles(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = configure_for(spark, 100 * (1 << 40))
        assert int(conf["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (128 << 20)
        small = configure_for(spark, 1 << 20)
        assert int(small["spark.sql.shuffle.partitions"]) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_persisted_table_reads_back_and_bags_prune_by_folder(spark):
    df = spark.range(0, 200).select(F.col("id"), (F.col("id") % 5).cast("int").alias("label"))
    back = persist_table(df, "t")
    assert back.count() == 200 and "InMemoryRelation" not in back._jdf.queryExecution().executedPlan().toString()
    bags = B.bootstrap(back, 3, 100, "same", seed=1)
    path = scratch_path(spark, "bags")
    B.write_bags(bags, path)
    local = path[len("file:"):] if path.startswith("file:") else path
    assert sorted(d for d in os.listdir(local) if d.startswith("bag=")) == ["bag=0", "bag=1", "bag=2"]
    one = spark.read.parquet(path).filter(F.col("bag") == 1)
    assert "PartitionFilters: [isnotnull(bag" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == bags.filter(F.col("bag") == 1).count()


def test_a_cluster_without_a_shared_folder_raises():
    import pytest
    from types import SimpleNamespace
    from strata.session import checkpoint_dir
    made = []
    context = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(
        master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append,
        getConf=lambda: SimpleNamespace(get=lambda k, d=None: d)))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            checkpoint_dir(context(master))
    assert checkpoint_dir(context("local[4]")) == made[-1]


def test_codes_only_queries_do_not_write_texts(spark):
    import glob
    from conftest import SF01
    from strata.plans import catalog as C
    root = checkpoint_root(spark)
    before = set(glob.glob(f"{root}/strata-*"))
    C.QUERIES["label_map"](spark, SF01)
    new = set(glob.glob(f"{root}/strata-*")) - before
    assert all("text_obj" not in spark.read.parquet(p).columns for p in new)


def checkpoint_root(spark):
    from strata.session import checkpoint_dir
    path = checkpoint_dir(spark)
    return path[len("file:"):] if path.startswith("file:") else path


def test_workers_import_the_package_when_started_elsewhere(tmp_path):
    """A job started from another folder, without PYTHONPATH: only the driver knows where the package is."""
    import subprocess
    import sys
    from conftest import ROOT
    job = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
           "from strata.session import get_spark\n"
           "spark = get_spark('local[2]', 2)\n"
           "def run(batches):\n"
           "    import strata.operators.heads as H\n"
           "    for b in batches: yield b\n"
           "run.__module__ = '__main__'\n"
           "print('rows', spark.range(5).mapInArrow(run, 'id long').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
