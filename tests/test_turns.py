"""Angles at the end of a turn, where last bits choose the sign."""

import math

import duckdb
from pyspark.sql import functions as F

from stridelake.functions import half_turn


def _beside(value, steps=4):
    found = [value]
    for to in (-math.inf, math.inf):
        v = value
        for _ in range(steps):
            v = math.nextafter(v, to)
            found.append(v)
    return found


def test_a_half_turn_ends_where_its_sql_ends_it(spark):
    turns = [v for end in (-540.0, -360.0, -180.0, 0.0, 180.0, 360.0) for v in _beside(end)]
    got = {r["v"]: r["t"] for r in spark.createDataFrame([(v,) for v in turns], "v double").select("v", half_turn(F.col("v")).alias("t")).collect()}
    con = duckdb.connect()
    want = dict(con.execute("select v, (((v + 180) % 360) + 360) % 360 - 180 from (select unnest(?::double[]) as v)", [turns]).fetchall())
    assert got == want
    assert got[math.nextafter(180.0, 0)] == -180.0
