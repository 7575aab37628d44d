"""Catalog queries against their SQL on the smallest tables."""

import duckdb
import pytest

from streetflow.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"sssp", "scc", "largest_scc", "small_scc_rows", "route_arcflags_cost", "route_arcflags_astar_cost"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(rows):
    return sorted([repr(x) if isinstance(x, float) else str(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SLOW])
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"select {quoted} from ({catalog.oracle_sql()[name]})").fetchall()
    assert text(df.select(columns).collect()) == text(want)


def test_estimation_lowers_error(spark):
    rows = catalog.queries()["estimate"](spark, SF).where("error is null").collect()
    assert rows and rows[0].mean_abs_last <= rows[0].mean_abs_first
