"""Physical plans: no cross joins, no Python workers, no whole-table windows, pruned scans."""

import os
import re

import pytest

from __spark_entry__ import queries

SF = os.environ.get("SLOFRAME_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

# These run streams or model fits while the plan is built; their result is a plain scan.
EAGER = {n for n in queries() if n.startswith("stream_")} | {
    "early_prediction", "early_prediction_model", "leave_family_out", "cross_validated_accuracy", "leave_one_out", "prediction_by_model", "late_rows", "late_rows_reconciled",
}


@pytest.fixture(scope="module")
def plans(spark):
    return {n: q(spark, SF)._jdf.queryExecution().executedPlan().toString() for n, q in queries().items() if n not in EAGER and not re.match(r"op\d+_|pipeline", n)}


@pytest.mark.parametrize("operator", ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"])
def test_no_plan_uses(plans, operator):
    assert [n for n, p in plans.items() if operator in p] == []


def windows_over_everything(plan):
    lines = plan.split("\n")
    return any(" Window [" in line and "SinglePartition" in "".join(lines[i + 1: i + 4]) for i, line in enumerate(lines))


def test_windows_over_a_whole_table_only_see_block_sums(plans):
    """``cyclic_fill``, the shuffles and the samples number a whole table: their only window
    without keys is over block counts, as are the quantiles of a summary without keys. Parts
    of an ordered export are added up file by file."""
    single = {n for n, p in plans.items() if windows_over_everything(p)}
    assert single <= {"cyclic_fill", "suite_summary_overall", "sample_n", "sample_half", "shuffled_mix", "ordered_series", "ordered_leaderboard", "quality_report_file"}


def test_scans_read_needed_columns_only(plans):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plans["latency_percentiles_linear"]).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["event_type", "user_id", "value"]


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plans["first_user_message"]
