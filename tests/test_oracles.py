"""Every query of the engine against its SQL oracle, on the smallest tables."""

import pytest
from oracle import connect, differences

from tideline.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_oracle(spark, con, name):
    assert differences(spark, con, catalog.queries()[name], ORACLES[name], SF) == ""
