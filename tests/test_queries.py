"""Every query against its SQL."""

import pytest
from compare import check, connect

from edgeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_like_sql(spark, con, name):
    check(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)
