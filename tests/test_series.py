"""Filling and smoothing, whose last bits choose between equal extremes."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridelake.functions import fill, fill_lists, smooth
from stridelake.plans import oracle


def test_smoothing_has_the_bits_of_its_sql(spark):
    draw = random.Random(5)
    rows = [(n, [draw.randrange(1000) / 1000 for _ in range(n)]) for n in (*range(1, 40), 66, 131)]
    got = {r["n"]: r["v"] for r in spark.createDataFrame(rows, "n int, v array<double>").repartition(3).select("n", smooth(F.col("v")).alias("v")).collect()}
    con = duckdb.connect()
    con.execute("create table lists as select unnest(?::int[]) as n, unnest(?::double[][]) as v", [[n for n, _ in rows], [v for _, v in rows]])
    first = "greatest(least(i - 5, n - 11), 0)"
    want = con.execute(f"with m as (select {oracle._MATRIX} as h) select n, case when n < 11 then v else list_transform(range(n), lambda i: list_dot_product(h[i - {first} + 1], v[{first} + 1 : {first} + 11])) end from lists, m").fetchall()
    assert got == dict(want)


def test_filling(spark):
    lists = [[None, 1.0, None, 3.0, None] * 3, [None] * 12, [1.0, None], [], [None] * 5 + [2.0] + [None] * 6]
    want = [[1.0, 1.0, 2.0, 3.0, 3 - 2 / 3, 3 - 4 / 3, 1.0, 2.0, 3.0, 3 - 2 / 3, 3 - 4 / 3, 1.0, 2.0, 3.0, 3.0], [0.0] * 12, [1.0, 0.0], [], [2.0] * 12]
    assert [pytest.approx(v) for v in fill_lists(pa.array(lists), 11).to_pylist()] == want
    # A slice of a column keeps its own values.
    assert fill_lists(pa.array(lists).slice(2, 2), 11).to_pylist() == want[2:4]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<double>").select("k", fill(F.col("v")).alias("v")).collect()
    assert [pytest.approx(r["v"]) for r in sorted(got)] == want
