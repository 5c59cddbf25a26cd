"""Registered queries against DuckDB on the smallest scale.

By default one query per area runs; set EVENTLOOM_ALL=1 for all of them.
"""

import os

import pytest

from eventloom.plans import load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DEFAULT = [
    "interval_merge_events", "storm_clusters", "temporal_conflict", "as_of_period", "series_gap_fill", "clean_requests", "normalize_segment_ids", "text_fallback_match",
    "keep_first_rows", "numeric_summary", "rank_bins", "value_bins", "class_metrics", "balanced_table", "leakage_audit", "point_in_polygon", "nearest_segment_max", "components", "snapped_network",
    "dbscan_labels", "dbscan_grid", "silhouette_exact", "factor_query", "cond_prob_table", "regression_metrics", "monthly_landing", "chunk_windows", "station_resolution", "composite_keys", "tide_levels", "geometry_parsing", "coordinate_coalescing",
]
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("EVENTLOOM_ALL") else DEFAULT)
def test_oracle(spark, con, name):
    out = compare(spark, con, QUERIES[name], SF)
    assert out.startswith("ok" if QUERIES[name].sql else "rows-only"), out


def test_every_inventory_area_is_registered():
    covered = {i for q in QUERIES.values() for i in q.covers}
    sizes = {"S": 28, "P": 20, "J": 21, "G": 25, "N": 11, "A": 34, "W": 12, "O": 7, "F": 32, "M": 40, "B": 8}
    missing = [f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1) if f"{k}{i}" not in covered]
    assert missing == []
