"""What the subpackage registers."""

from __future__ import annotations

import re

import __spark_entry__ as registered
from checks.compare import differences, oracle
from tests.conftest import SMALL
from trailmetrics.llm.registry import llm_oracles, llm_queries


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in llm_queries())
    assert numbers == list(range(1, 14))
    assert llm_queries().keys() | {"pipeline"} <= registered.queries().keys()


def test_queries_with_sql_equal_it(spark):
    con = oracle(SMALL)
    for name, sql in llm_oracles().items():
        assert differences(llm_queries()[name](spark, SMALL), con, sql) == []
