"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from engines import compare
from haulmark.plans.catalogue import REGISTRY

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, small, name):
    result = compare(spark, duck, small, name, QUERIES[name], CHECKS.get(name))
    assert result.startswith(("OK", "ROWS")), result


def test_every_query_of_the_library_has_a_check():
    assert [name for name, q in REGISTRY.items() if not q.sql] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
