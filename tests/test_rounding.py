"""Values that end in a half at their last place are rounded as in the SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stridelake.functions import round_off
from stridelake.plans import jobs
from tests.oracle import views

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("digits", [1, 2, 4, 5, 6, 7])
def test_halves(spark, digits):
    draw, size = random.Random(digits), 10**digits
    values = [(draw.randrange(-180 * size, 180 * size) + 0.5) / size for _ in range(3000)] + [0.0, -0.0, 99.0, 1 / 3, None, float("nan")]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    con = duckdb.connect()
    want = con.execute(f"select round(v, {digits}) from (select unnest(?::double[]) as v)", [values]).fetchall()
    # The sign of a zero is left out.
    plain = lambda v: repr(v if v is None else v + 0.0)
    got = lambda made: [plain(r[1]) for r in sorted(made.collect(), key=lambda r: r[0])]
    want = [plain(v) for (v,) in want]
    assert got(rows.select("k", round_off("v", digits))) == want
    assert got(jobs.rounded(rows, digits)) == want
    if digits > 1:
        assert got(rows.select("k", F.round("v", digits))) != want


def test_key_frames_take_the_sql_rounding(spark, monkeypatch):
    # The second value is the larger at six places only where halves go by decimal text.
    con, near = views(BASE), None
    for k in range(100_000, 200_000):
        v = (k + 0.5) / 1e6
        if con.execute("select round(?::double, 6)", [v]).fetchone()[0] < (k + 1) / 1e6:
            near = v, k / 1e6
            break
    y = [0.0, near[1], near[0], 0.0, 0.0]
    ch = lambda v: (v,)
    rows = spark.createDataFrame([(1, 5, ch(y), ch(y))], "clip_id long, n int, wrist struct<y2: array<double>>, knee struct<y2: array<double>>")
    monkeypatch.setattr(jobs, "sided", lambda *_: rows)
    assert {r["key"]: r["f"] for r in jobs.key_frames(spark, BASE).collect()} == {"dip": 1, "release": 0, "bend": 1}


def test_zero_keeps_its_sign(spark):
    """As in the SQL, where a text of -0.04 at one place is -0.0."""
    values = [-0.04, 0.04, -0.0, 0.0, -0.05, -7.0]
    with duckdb.connect() as con:
        want = [con.execute("select round(?::double, 1)", [v]).fetchone()[0] for v in values]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r[0] for r in rows.orderBy("k").select(F.to_json(F.struct(round_off("v", 1).alias("v")))).collect()]
    assert got == [f'{{"v":{w!r}}}' for w in want] and got[0] == '{"v":-0.0}'
