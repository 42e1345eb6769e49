"""Values beyond 500, turns beyond half a circle: queries and their SQL follow the same rule."""

import datetime as dt
import os
import random
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import compare  # noqa: E402

from motiontables.plans.registry import full_catalog  # noqa: E402


@pytest.mark.parametrize("name", ["quat_axis_roundtrip", "fill_rotation"])
def test_turns_beyond_half_a_circle(spark, tmp_path, name):
    r = random.Random(4)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(200)), i % 3, r.choice(["click", "view", "signup", "error"]),
             round(r.uniform(0, 980), 2), '{"k": %d}' % (i % 50)) for i in range(120)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    cat = full_catalog()
    status, _, note = compare(spark, con, name, cat.queries[name], cat.sql[name], str(tmp_path))
    assert status == "ok", note
