"""A crowd of near views is selected without its pairs, whose number grows with the square of the crowd."""

import math
import random

from motiontables.operators import views
from motiontables.plans.registry import full_catalog

SCHEMA = "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string"


def test_selection_of_a_crowd_makes_no_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.uniform(0, 400), rng.gauss(3000, 30), 700.0]), i % 2, "BUILDING") for i in range(900)]
    rows += [(900 + i, x, 0, "BUILDING") for i, x in enumerate([None, None, math.nan, math.nan])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/customer.parquet")
    held, whole = [], views.cut

    def counted(df):
        out = whole(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(views, "cut", counted)
    got = {r.c_custkey: r.kept for r in full_catalog().queries["keep_first_views"](spark, str(tmp_path)).collect()}
    kept = []
    for i, x, nation, _ in rows:
        if x is None or math.isnan(x) or all(n != nation or not math.sqrt((x / 100 - y / 100) ** 2 / 2) < 0.3001 for _, y, n in kept):
            kept.append((i, math.inf if x is None or math.isnan(x) else x, nation))
    assert len(got) == len(rows) and {i for i, on in got.items() if on} == {i for i, _, _ in kept}
    assert max(held) <= len(rows)


def test_selection_in_many_dimensions(spark):
    rng = random.Random(8)
    rows = [(k, i, [rng.uniform(0, 1) for _ in range(6)]) for k in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "k string, id int, v array<double>").repartition(5)
    got = {(r.k, r.id) for r in views.keep_first_near(df, ["k"], "id", "v", 6, .35, points=3).filter("kept").collect()}
    kept = []
    for k, i, v in rows:
        if all(o != k or math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)) / 3) >= .35 for o, _, w in kept):
            kept.append((k, i, v))
    assert got == {(k, i) for k, i, _ in kept}
