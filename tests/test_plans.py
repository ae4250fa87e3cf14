"""Plan-shape checks: the properties the scale design relies on."""

import os
import sys

import pytest

import __spark_entry__ as E
from conftest import SF01

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from plan_report import _outside_cache, summarize  # noqa: E402


def _plan(spark, name):
    return E.queries()[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["split", "bootstrap_same", "mix_columns", "upsample_shuffle", "encode_ids",
                                  "predictions_export", "eval_summary", "loss_ice", "label_levels"])
def test_no_nested_loop_or_cartesian_joins(spark, name):
    assert summarize(_plan(spark, name))["nested_loop"] == 0


@pytest.mark.parametrize("name", ["loss_ce", "loss_focal", "loss_per_row", "argmax", "vote_soft", "vote_hard"])
def test_per_row_scores_do_not_explode_rows(spark, name):
    plan = _outside_cache(_plan(spark, name))
    assert "Generate" not in plan
    assert summarize(plan)["shuffles"] <= 1


def test_split_ranks_only_the_straddling_bucket(spark):
    s = summarize(_plan(spark, "split"))
    assert s["windows"] == 1 and s["shuffles"] == 1


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "loss_ce")
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in plan or \
        "ReadSchema: struct<label:int,embedding:array<float>>" in plan


@pytest.mark.parametrize("name", ["eval_summary", "class_scores", "loss_ice", "ensemble_evaluate"])
def test_scores_scan_their_input_once(spark, name):
    plan = E.queries()[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
