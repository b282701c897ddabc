"""Registered queries against their SQL twins in DuckDB.

A fast selection by default; TEST_ALL=1 runs every query.
"""

import os

import pytest
from compare import compare, duck

from tidemark.plans.catalog import CATALOG

FAST = [
    "impute_and_log", "standardise", "index_maps", "apply_large_index_maps", "exact_field_quantiles",
    "exact_batch_medians", "enrich_items", "batch_metrics", "auc_of_many_levels", "drift_report",
    "drift_summary", "fit_curves", "field_summary", "monotonicity", "scale_offset", "scoring_summary",
    "spline_basis", "curve_values", "upsert_results", "envelope_round_trip", "score_in_batches",
    "bucket_encoding", "miscalibrated_batches", "timing_summary",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(CATALOG) if os.environ.get("TEST_ALL") else FAST)
def test_query(spark, con, sf_dir, name):
    entry = CATALOG[name]
    assert compare(spark, con, entry.run, entry.sql, sf_dir) is None
