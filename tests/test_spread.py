"""Spreads and steps have the last bits of the SQL: fluidity is cut to whole numbers."""

import random

import duckdb
from pyspark.sql import functions as F

from stridelake.functions import second_difference, spread


def test_last_bits(spark):
    draw = random.Random(6)
    lists = [[draw.randrange(400, 700) / 1e3 + draw.randrange(5) * 0.4 / 7 for _ in range(draw.randrange(4, 40))] for _ in range(500)] + [[0.5, 0.5, 0.5, 0.5]]
    steps = lambda y: f"list_transform(range(len({y}) - 2), lambda i: {y}[i + 3] - 2 * {y}[i + 2] + {y}[i + 1])"
    with duckdb.connect() as con:
        con.execute("set threads = 1")
        con.execute("create table t as select unnest(range(len(?)))::int as k, unnest(?::double[][]) as y", [lists, lists])
        want = con.execute(f"select k, any_value(d), stddev_pop(v) from (select k, d, unnest(d) as v from (select k, {steps('y')} as d from t)) group by k order by k").fetchall()
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, y array<double>")
    got = rows.select("k", second_difference(F.col("y")).alias("d"), spread(second_difference(F.col("y")))).orderBy("k").collect()
    assert [tuple(r) for r in got] == want


def test_edges(spark):
    rows = spark.createDataFrame([(0, []), (1, [2.0]), (2, [2.0, 4.0])], "k int, y array<double>")
    got = rows.select("k", spread(F.col("y")), F.size(second_difference(F.col("y")))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(None, 0), (0.0, 0), (1.0, 0)]
