"""Least squares over the lines of an order: exact sums, halves decided by value and not by the order of the rows."""

import datetime as dt

from motiontables.plans.registry import full_catalog

# Results by fractions, rounded half away from zero. A sum of doubles gave the neighbour for each.
ORDERS = {
    38808: ([(1, 48.0, 0.01, 0.06), (2, 10.0, 0.01, 0.0), (5, 1.0, 0.06, 0.05)], (-0.2354688, -2.8800313, 8.115625)),
    130588: ([(4, 29.0, 0.03, 0.03), (1, 4.0, 0.02, 0.02), (6, 22.0, 0.07, 0.01)], (0.6046875, -3.9064688, 23.046875)),
    132212: ([(4, 45.0, 0.08, 0.03), (5, 6.0, 0.03, 0.04), (5, 24.0, 0.07, 0.02)], (-5.0018229, -4.8283438, -18.234375)),
}


def test_translation_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    for turn in (1, -1):
        rows = [(k, *line) for k, (lines, _) in ORDERS.items() for line in lines[::turn]] + [(7, 1, float("nan"), 0.01, 0.02)]
        path = tmp_path / str(turn)
        spark.createDataFrame([(k, 1, 1, n, q, 1.0, d, t, "A", "O", dt.datetime(2024, 1, 1)) for k, n, q, d, t in rows], (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")).write.parquet(
            str(path / "lineitem.parquet"))
        found = {r.k: r for r in full_catalog().queries["lsq_translation"](spark, str(path)).collect()}
        assert {k: (found[k].tx, found[k].ty, found[k].tz) for k in ORDERS} == {k: v for k, (_, v) in ORDERS.items()}
        assert found[7].reason == "degenerate"
