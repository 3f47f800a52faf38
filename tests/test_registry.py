"""Registered queries against their SQL at the smallest scale.

A cross-section by default; CALLBOOK_ALL_CHECKS=1 runs every one (see also
tools/compare.py).
"""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

import compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from callbook.checks.registry import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = [
    "listing_scan", "chart_scan", "sitemap_urls", "ingest_coverage", "meta_tags",
    "head_truncation", "page_titles", "price_book", "close_on_or_after", "stance_buckets",
    "coverage_cascade", "frontier_results", "relabel_moves", "month_plan", "resolve_symbols",
    "history_marks", "volume_by_week", "article_ordinals", "stance_flips_all", "author_table",
    "outcomes_incremental", "call_types", "growth_series", "returns_since", "study_paired",
    "study_verdict", "author_leaderboard", "coverage_timeline_raw",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("CALLBOOK_ALL_CHECKS")
                         else CROSS_SECTION)
def test_same_answer_as_sql(spark, con, name):
    assert compare.compare(spark, con, FOLDER, name) == ""


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(CROSS_SECTION) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 5 and "median_12m" in df.columns
