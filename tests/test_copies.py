"""Copies stand under their first view: no pairs among copies, the same views kept."""

from motiontables.plans.registry import full_catalog


def test_copies_are_not_paired_with_each_other(spark, tmp_path):
    rows = [(i, 100.0 * (i % 2) + (0.2 if i >= 40 else 0.0), 1, "BUILDING") for i in range(42)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    queries = full_catalog().queries
    pairs = [(r.first, r.second, r.rms) for r in queries["near_duplicate_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(p[:2] for p in pairs if p[2] == 0) == sorted((i % 2, i) for i in range(2, 40))
    assert sorted(p[:2] for p in pairs if p[2] > 0) == [(0, 40), (1, 41)] and len(pairs) == 40
    kept = {r.c_custkey for r in queries["keep_first_views"](spark, str(tmp_path)).filter("kept").collect()}
    assert kept == {0, 1}
