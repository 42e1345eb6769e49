import random

import pytest
from pyspark.sql import functions as F

from motiontables.functions import rotation
from motiontables.operators import geometry
from motiontables.plans.registry import full_catalog


def test_packet_round_trip_in_steps_equals_the_one_expression(spark):
    rng = random.Random(5)
    poses = [([rng.gauss(0, 1) for _ in range(4)], [rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-0.5, 4)]) for _ in range(60)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(poses)], "i int, q array<double>, t array<double>").select(
        "i", rotation.quat_to_matrix(rotation.unit(F.col("q"))).alias("r"), "t")
    k = F.array(*[F.lit(v) for v in (600.0, 610.0, 320.0, 240.0)])
    for d in ([0.01, -0.02, 0.001, 0.0005], [0.0] * 12):
        d = F.array(*[F.lit(v) for v in d])
        given = (F.col("r"), F.col("t"), F.lit(0.0635), F.lit(0.0889))
        found = geometry.packet_round_trip(rows, *given, k, d).select("i", "position_cm", "rotation_quat", "corner_gap")
        one = rows.select("i", geometry.packet_pose(F.col("r"), F.col("t")).alias("p"), geometry.corner_round_trip(*given, k, d).alias("corner_gap"))
        assert sorted(found.collect()) == sorted(one.select("i", "p.position_cm", "p.rotation_quat", "corner_gap").collect())


@pytest.mark.parametrize("name", ["packet_pose", "edge_associations"])
def test_rows_are_computed_without_lambdas(spark, name):
    """Lambdas over each observation or segment are interpreted; only the few edges of a quad may have them."""
    plan = full_catalog().queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "lambda" in line]
    assert not [line for line in lines if "corners" not in line and "p_size" not in line]
    # An edge's length is no part of the conditions on segments, where it would be worked out again and again.
    assert not [line for line in plan.splitlines() if "Filter" in line and "ACOS" in line and "POWER" in line]
