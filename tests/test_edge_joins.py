"""Quads and their edges are joined by key at every size, never sent whole to each task."""

from motiontables.plans.registry import full_catalog

BASE = "/root/testdata/sf0.001"


def test_quads_are_not_broadcast(spark):
    df = full_catalog().queries["edge_associations"](spark, BASE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert df.count() > 0
