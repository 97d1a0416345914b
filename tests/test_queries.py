import pytest
from check_queries import connect, difference
from conftest import SF

import __spark_entry__ as entry

# Every query is compared by check_queries.py; these are a quick cross-section.
SOME = [
    "a3_directory_pruning", "a7_file_cap", "a11_repo_references", "b1_lines", "b10_findings", "c2_whole_file_rules", "c4_suppress_by_rule",
    "c6_checklists", "c11_response_lookup", "d1_language_breakdown", "d4_assessment", "e1_synthetic_ids", "e4_bundle_packing", "i6_added_marks",
    "k5_script_targets", "k7_context_blocks", "l6_parsed_responses", "j4_json_report", "j7_bundle_report", "n4_stream_unchanged", "i5_catalog_lint",
]


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, name):
    wrong, _ = difference(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert wrong is None


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from scangrove.plans.oracle import ORACLES
    from scangrove.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
