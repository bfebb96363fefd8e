"""Plan-shape regression tests: the properties the design relies on at
scale, checked on the physical plans (planning only, no full runs)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(spark, name):
    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_nested_loop_or_row_udf(spark, name):
    plan = _plan(spark, name)
    for op in FORBIDDEN:
        assert op not in plan, (name, op)
    # a single-partition exchange only ever carries partial aggregates
    lines = plan.splitlines()
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            assert "partial_" in lines[i + 1], (name, lines[i + 1])


def test_state_hash_aggregates_the_pushes(spark):
    plan = _plan(spark, "alert_state")
    # the aggregate over the input is a hash aggregate keyed by label set
    first_agg = [ln for ln in plan.splitlines() if "Aggregate(keys=" in ln][-1]
    assert "HashAggregate" in first_agg and "partial_max_by" in first_agg


def test_listings_are_top_k(spark):
    for name in ("list_firing", "list_firing_unmuted", "list_expired", "matching_alerts"):
        assert "TakeOrderedAndProject" in _plan(spark, name), name


def test_mute_overview_limits_before_the_shuffle(spark):
    plan = _plan(spark, "mute_overview")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_state_machine_partitions_by_key_once(spark):
    plan = _plan(spark, "delivery_plan")
    assert plan.count("Exchange hashpartitioning(rule_name") == 1 and "_chunk" not in plan
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["route_decisions", "delivery_plan", "process_replay", "muted_alerts", "unmuted_alerts"])
def test_alerts_are_read_once(spark, name):
    """The label-set tables are checkpointed; what runs last scans the events a single time."""
    assert _plan(spark, name).count("FileScan parquet") == 1


def test_routing_is_one_projection_of_bit_masks(spark):
    plan = _plan(spark, "route_decisions")
    assert "Exchange" not in plan and "Join" not in plan and "lambda" not in plan.split("FileScan")[0].split("Generate")[0]
