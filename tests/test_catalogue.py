"""Every registered query against its SQL counterpart on the smallest tables."""

import re

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    _, rows, problem = check.compare(spark, duck, FOLDER, name)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_every_query_of_the_library_has_an_oracle():
    own = {n for n in queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert own <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
