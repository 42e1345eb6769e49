"""Pairs of near views are whole: copies pair with each other and with all that is near them."""

import math

from motiontables.plans.registry import full_catalog


def test_every_near_pair_of_copies(spark, tmp_path):
    values = [(i, 100.0 * (i % 3) + (20.0 if i >= 20 else 0.0) if i != 7 else None) for i in range(30)]
    values += [(30, math.nan), (31, math.nan), (32, None)]
    rows = [(i, v, 1, "BUILDING") for i, v in values]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = full_catalog().queries["near_duplicate_pairs"](spark, str(tmp_path)).collect()
    known = [(i, v / 100) for i, v in values if v is not None and not math.isnan(v)]
    want = {(i, j): round(math.sqrt((a - b) ** 2 / 2), 8) for i, a in known for j, b in known if i < j and math.sqrt((a - b) ** 2 / 2) < 0.3001}
    assert len(got) == len(want) and {(r.first, r.second): r.rms for r in got} == want
