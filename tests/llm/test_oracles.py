"""Registered queries against their SQL."""

import pytest

from civicframe.llm.queries import ORACLE, QUERIES
from workload.compare import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
