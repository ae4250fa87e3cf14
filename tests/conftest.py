import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from strata.session import get_spark
    # Up to 4 attempts per task, as on a cluster, so retry behavior is exercised.
    s = get_spark(master="local[*,4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    from strata.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF01}/{t}.parquet')")
    return con
