"""Queries whose rows SQL can express, over whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare  # noqa: E402

from quillwatch.llm import oracles, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, queries.QUERIES[name], oracles.ORACLES[name]) > 0
