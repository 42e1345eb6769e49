"""Shares of an edge at the limit, and what a seed's copies weigh."""

from motiontables.operators import candidates


def test_share_at_the_limit_counts(spark):
    low, high = next((a / 10, round(a / 10 + 51.15, 2)) for a in range(1, 999) if (round(a / 10 + 51.15, 2) - a / 10) / 341.0 < 0.15)
    rows = [("k", 0, 1, 1, low, high, 3.0, 341.0)]
    m = spark.createDataFrame(rows, "k string, edge int, seed long, line_id long, low double, high double, distance double, edge_length double")
    assert candidates.collinear_clusters(m, ["k"]).count() == 1


def test_seeds_meet_segments_without_arrays(spark, capsys):
    a = spark.createDataFrame([("k", 0, i, [0.0, float(i % 3)], [90.0, float(i % 3)], 90.0, 0.0, 90.0, float(i % 3), 100.0, [0.0, 0.0], 1.0, 0.0) for i in range(9)], """
        k string, edge int, line_id long, a array<double>, b array<double>, length double, low double, high double, distance double, edge_length double,
        origin array<double>, ux double, uy double""")
    m = candidates.collinear_members(a, ["k"])
    assert sorted((r.seed, r.line_id) for r in m.collect()) == sorted((s, i) for s in range(3) for i in range(9) if abs(s - i % 3) <= 2.5)
    assert candidates.STRIPS <= 4
    m.explain()
    assert "sa#" not in capsys.readouterr().out
