import random
import statistics

import pytest
from pyspark.sql import functions as F

from motiontables.operators import quantiles


def test_small_groups_are_ranked_without_objects(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, float("nan"), 0.0, -1.5, rng.gauss(0, 9)])) for _ in range(900)] + [("x", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    q = quantiles.bounded_quantiles(df, ["k", "j"], F.col("v"), {"m": 0.5, "top": 0.9})
    assert "ObjectHashAggregate" not in q._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, r.j): r for r in q.collect()}
    assert set(found) == {(k, j) for k, j, _ in rows} and found["x", 1].n == 0 and found["x", 1].m is None
    for key, r in found.items():
        own = sorted(v for k, j, v in rows if (k, j) == key and v is not None and v == v)
        assert r.n == len(own)
        if own:
            at = 0.9 * (len(own) - 1)
            low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            assert r.m == pytest.approx(statistics.median(own)) and r.top == pytest.approx(low + (high - low) * (at - int(at)))


def test_values_are_dealt_once_for_both_readers(spark):
    """Both readers of the values share an exchange, and two joins are enough."""
    df = spark.range(200_000).select((F.col("id") % 7).alias("k"), F.exp((F.xxhash64("id") % 1000) / 100.0).alias("v"))
    q = quantiles.exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5})
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    own = {}
    for r in df.collect():
        own.setdefault(r.k, []).append(r.v)
    assert {r.k: r.m for r in q.collect()} == pytest.approx({k: statistics.median(v) for k, v in own.items()})
    assert plan.count("SortMergeJoin") <= 2
