"""Every registered query of the library gives the rows of its SQL."""

import pytest

from lotwise.plans import registry
from oracle import connect, difference

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER)


#: Queries without SQL, and the tests that hold their rows against brute force or against properties of every row.
CHECKED_ELSEWHERE = {
    "chunk_documents": "test_chunks_of_documents", "estimate_page": "test_pages_of_chunks", "locate_snippets": "test_places_of_snippets", "locate_altered_snippets": "test_places_of_altered_snippets",
    "build_criterion_prompts": "test_prompts_of_all_criteria", "job_reports": "test_job_reports",
    "failure_index": "test_failure_index", "audit_reports": "test_audit_reports_are_bounded", "dashboard_pieces": "test_pieces_of_dashboards",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        assert difference(df, registry.SQL[name], duck) is None
    else:
        assert name in CHECKED_ELSEWHERE and df.count() > 0


#: Queries whose rows have shown what the smallest tables don't hold: small and tied numbers, results that are judged again.
@pytest.mark.parametrize("name", ["dashboard_criteria", "ocr_quality_failed_pages", "apply_reviews", "evaluation_events", "explanations", "decisions_with_stored"])
def test_larger_tables(spark, larger, name):
    assert difference(registry.QUERIES[name](spark, LARGER), registry.SQL[name], larger) is None
