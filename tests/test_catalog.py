"""A spread of registered queries against their SQL (all of them: tests/run_checks.py)."""

import pytest
from harness import compare

from plumbline.catalog import load_all

QUERIES, ORACLES = load_all()
PICK = [
    "fn14_title_case", "fn27_hash31", "cl01_permit_trades", "cl26_fence_signals", "cl30_contradictions", "sm10_trade_matrix", "wn01_first_per_key", "wn15_best_trade",
    "ag15_relationships", "jn03_match_on_either_key", "ex02_quantities", "er05_duplicate_document_components", "sr05_semantic_search", "sk02_upsert_fields", "sc10_html_to_text",
]


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(name, spark, con, sf):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200
