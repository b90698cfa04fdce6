"""Queries of the training-data operators give the rows of their SQL."""

import pytest

from lotwise.llm.queries import QUERIES, SQL
from oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), SQL[name], connect(SF)) is None
