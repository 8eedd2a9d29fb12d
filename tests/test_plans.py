"""Plan-shape checks: the properties that matter at scale, asserted on the
physical plans of the registered queries (smallest tables)."""

import pytest

from riskloom.plans import scalars, surface

from conftest import SF001


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + qe.optimizedPlan().toString()


LAZY = {**surface.QUERIES, **scalars.QUERIES}


@pytest.mark.parametrize("name", sorted(LAZY))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(LAZY[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unused_branches_are_pruned(spark):
    # The histogram reads only the score: no lineitem scan, no label window.
    plan = _plan(surface.QUERIES["ag7_histogram"](spark, SF001))
    assert "lineitem" not in plan and "Window" not in plan


def test_projection_prunes_scan_columns(spark):
    df = surface.QUERIES["pr2_project_except"](spark, SF001)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<l_quantity" in text and "l_partkey" not in text.split("ReadSchema")[1].split("\n")[0]


def test_layout_enables_partition_pruning(spark):
    from riskloom.plans import io
    df = io.QUERIES["io10_layout"](spark, SF001)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(risk_tier" in text and "PushedFilters: [IsNotNull(score), GreaterThanOrEqual(score,0.9)]" in text
