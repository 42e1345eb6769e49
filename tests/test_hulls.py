"""Hulls meet Python once a group, with two points for each x."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiontables.operators import motion


def test_points_fold_before_python(spark, capsys):
    rows = [("a", float(i % 5), float(i % 7)) for i in range(700)] + [("a", float("nan"), 1.0), ("b", 1.0, None), ("c", 2.0, 2.0), ("c", 3.0, 3.0)]
    points = spark.createDataFrame(rows, "k string, x double, y double")
    assert {r.k: r.hull_area for r in motion.hull_area(points, ["k"]).collect()} == {"a": 24.0, "b": 0.0, "c": 0.0}
    motion.hull_area(points, ["k"]).explain()
    plan = capsys.readouterr().out
    assert "MapInPandas" not in plan and plan.count("FlatMapGroupsInPandas") == 1


def test_vertices_equal_the_hull_of_all_points(spark):
    xy = np.round(np.random.default_rng(3).normal(size=(500, 2)), 2)
    points = spark.createDataFrame([("k", float(a), float(b)) for a, b in xy], "k string, x double, y double")
    got = sorted((r.x, r.y) for r in motion.hull_vertices(points, ["k"]).collect())
    assert got == sorted(map(tuple, motion.hull(xy)))
    assert motion.hull_area(points, ["k"]).select(F.round("hull_area", 6)).first()[0] == pytest.approx(
        motion.hull_area(points.union(points), ["k"]).first()[1], abs=1e-6)
