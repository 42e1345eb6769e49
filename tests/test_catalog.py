"""Every registered query against its SQL on the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import TABLES, compare  # noqa: E402

from motiontables.plans.registry import full_catalog  # noqa: E402

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = full_catalog()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(BASE), reason="warehouse tables absent")
@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, con, name):
    status, _, note = compare(spark, con, name, CATALOG.queries[name], CATALOG.sql.get(name), BASE)
    assert status in ("ok", "rows-only") or (status == "EMPTY" and "sf0.001" in BASE), note
