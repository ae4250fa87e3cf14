"""Every registered query against its DuckDB twin at sf0.01 (the driver's gate)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF01

SQL = E.oracle_sql()
from strata.plans.catalog import QUERIES, SQL as OWN_SQL  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql_twin(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_a_twin_or_is_a_library_fit():
    assert set(QUERIES) - set(OWN_SQL) == {"train_linear", "train_mlp", "refit_swapped", "train_text", "train_ice"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["part", "label", "id", "copy", "slot", "text"]
    assert df.count() > 0
