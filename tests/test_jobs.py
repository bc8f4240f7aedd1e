"""Every job with an oracle gives the oracle's rows."""

import pytest

from stridelake.plans.jobs import Q
from stridelake.plans.oracle import ORACLE
from tests.oracle import compare, views

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(BASE)


@pytest.mark.parametrize("name", sorted(Q))
def test_job(spark, con, name):
    df = Q[name](spark, BASE)
    if name in ORACLE:
        compare(df, ORACLE[name], con)
    else:
        assert df.collect() is not None
