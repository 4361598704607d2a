"""Registered queries against their cross-check SQL.

A sample per family runs by default on the smallest data; FULL_ORACLE=1 runs all.
"""

import os

import pytest

from evidquarry.plans import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "a1_count", "a4_overview", "a6_section", "a11_bm25_top_k", "a12_rare_terms", "a18_grouping_sets", "a23_pairwise_summary",
    "a31_latency_percentiles", "a34_threshold_calibration", "c2_hybrid_retrieve", "c10_claim_verification", "j8_case_predicate_join",
    "r5_source_intent", "s1_vector_top_k", "s17_catalog_contract", "s19_html_text_lines", "w3_authoritative_versions", "w7_preserve_primary",
    "x33_line_kinds", "x50_date_number_anchors",
)
NAMES = sorted(ORACLES) if os.environ.get("FULL_ORACLE") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, note
