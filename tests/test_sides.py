"""Sides that are seen alike but for the last bits go by the order of the frames, which the SQL
adds from the first to the last for a clip and from the last to the first for its shots."""

from stridelake.operators import metrics, shots

AXES = "struct<x2:array<double>,y2:array<double>,v2:array<double>,x3:array<double>,y3:array<double>,z3:array<double>>"


def add(values):
    out = 0.0
    for v in values:
        out += v
    return out


def test_order_of_adding_decides(spark):
    left = next([a / 10, b / 10, c / 10, 0.1, 0.3] for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) if add([a / 10, b / 10, c / 10, 0.1, 0.3]) > add([0.3, 0.1, c / 10, b / 10, a / 10]))
    right = left[::-1]
    y = [0.9, 0.8, 0.7, 0.6, 0.5]
    one = lambda v: (y, y, v, y, y, y)
    ch = {f"{s}_{j}": one(left if s == "left" else right) for s in ("left", "right") for j in metrics.JOINTS}
    rows = spark.createDataFrame([(1, 30.0, 1.0, 10, 10, 0.5, ch, one(left), 5)], f"clip_id long, fps double, ar double, width int, height int, visibility double, ch map<string,{AXES}>, wrist {AXES}, n int")
    assert metrics.sides(rows).first()["side"] == "left"
    assert [r["side"] for r in shots.per_shot(rows).collect()] == ["right"]
