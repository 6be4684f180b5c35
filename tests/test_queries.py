"""Registered queries against their oracle SQL. All of them with TERRAMETRA_ALL_QUERIES=1, else one per area."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from terrametra.plans import catalog

FOLDER = os.environ.get("TERRAMETRA_DATA", "/root/testdata/sf0.001")
SOME = [
    "municipal_rollup", "market_metrics", "demand_rollup", "percentile_strict", "exact_quantile", "nearest_by_rings", "point_in_polygon",
    "radius_count", "entity_resolution", "snapshot_diff", "diffusion_projection", "walk_forward", "street_dossier", "site_selection",
    "listing_tracker", "investment_basket", "fixed_width_verify", "html_listing_extract", "demand_stream", "rate_limit_flags",
]
NAMES = sorted(catalog.queries()) if os.environ.get("TERRAMETRA_ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(entry.oracle_sql()[name])
    want = canonical(rel.fetchall(), [d[0] for d in rel.description])
    assert canonical(rows, df.columns) == want


def test_registry_is_complete():
    assert set(catalog.oracles()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracles()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["nearest_by_rings", "point_in_polygon", "queen_sum", "event_study", "entity_resolution", "partial_name_join", "fill_cross_join"])
def test_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    plan = entry.queries()["employment_band"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_name" not in plan
