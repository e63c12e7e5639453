"""Registered queries against their SQL at the smallest scale.

The default run takes some of every group; ``PAGEMILL_ALL=1`` takes all of them.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
USUAL = ["q_product_fields", "q_validate", "q_search_requests", "q_market_dim", "q_page_elements",
         "q_sel_all", "q_capture_outcome", "q_has_next", "q_page_reach", "q_cap_per_term",
         "q_link_products", "q_upsert_new", "q_store_envelope", "q_run_summary", "q_run_store", "q_run_rejects", "q_collapse",
         "q_stream_cap", "q_stream_resume", "q_stream_quarantine"]
NAMES = list(QUERIES) if os.environ.get("PAGEMILL_ALL") else USUAL


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert "title" in df.columns and df.limit(1).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SF) == ""
