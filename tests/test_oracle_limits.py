"""Every oracle returns in time when it is read under a row limit."""

import threading

import pytest

from stridelake.plans.oracle import ORACLE
from tests.oracle import views

SECONDS = 20


@pytest.fixture(scope="module")
def con():
    return views("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_under_a_limit(con, name):
    stop = threading.Timer(SECONDS, con.interrupt)
    stop.start()
    try:
        con.execute(f"select * from ({ORACLE[name]}) limit 1000000").fetchall()
    finally:
        stop.cancel()
