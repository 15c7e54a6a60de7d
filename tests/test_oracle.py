"""Registered queries against DuckDB on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from touchline.catalog import REGISTRY
from tools.check import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF_DIR, name)
    assert ok, note


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n, (_, sql) in REGISTRY.items() if sql is None} == {"analysis_matchups", "analysis_pairs", "analysis_templates", "event_alignment", "phase_classifier", "strength_ml"}


def test_entry(spark):
    assert entry.entry(spark).count() == 4
