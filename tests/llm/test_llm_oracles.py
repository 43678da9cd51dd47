"""The queries of this package that SQL can express against their oracles, on the smallest tables."""

import pytest
from oracle import connect, differences

from tideline.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, name):
    assert differences(spark, connect(SF), queries()[name], oracle_sql()[name], SF) == ""
