"""Column functions that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stretches of samples that are smoothed at once, a multiple of a tile.
STRETCHES, TILE = 1 << 15, 64


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` held between two bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def round_off(value: Column | str, digits: int) -> Column:
    """A double at so many places, halves away from zero, as SQL engines do: its
    product with the power of ten is rounded.  ``F.round`` goes by the shortest decimal
    text instead, and differs where that ends in a 5 which the product misses; it also
    loses the sign of what becomes zero, which texts show."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(F.abs(value) * float(10**digits), 0) / float(10**digits) * F.signum(value)


def zero_is_missing(value: Column, default: float) -> Column:
    """``value``, or the default where it is null or zero."""
    return F.coalesce(F.when(value != 0, value), F.lit(default))


def lenient_double(text: Column) -> Column:
    """A number from text; blank or unreadable text is null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def angle(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...]) -> Column:
    """Degrees at ``b`` between ``a`` and ``c``; 0 where a point is missing or a
    side has no length."""
    u, v = [p - q for p, q in zip(a, b)], [p - q for p, q in zip(c, b)]
    dot = sum((p * q for p, q in zip(u[1:], v[1:])), u[0] * v[0])
    length = lambda w: F.sqrt(sum((p * p for p in w[1:]), w[0] * w[0]))
    nu, nv = length(u), length(v)
    return F.when((nu >= 1e-9) & (nv >= 1e-9), F.degrees(F.acos(F.greatest(F.least(dot / (nu * nv), F.lit(1.0)), F.lit(-1.0))))).otherwise(F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def half_turn(degrees: Column) -> Column:
    """Degrees from -180 up to 180; what is 180 but for its last bits is -180."""
    turned = degrees + 180.0
    return (turned % 360 + 360) % 360 - 180.0


def spread(values: Column) -> Column:
    """Population standard deviation of an array; null where it is empty.  The mean
    moves from value to value, as in SQL engines: what is cut to whole numbers later goes
    by the last bits."""

    def step(s: Column, v: Column) -> Column:
        n, mean = s["n"] + 1.0, s["mean"] + (v - s["mean"]) / (s["n"] + 1.0)
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    start = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mean", "squares")])
    return F.aggregate(values, start, step, lambda s: F.sqrt(s["squares"] / F.nullif(s["n"], F.lit(0.0))))


def second_difference(values: Column) -> Column:
    """``y[i+2] - 2 y[i+1] + y[i]`` of an array, taken in this order."""
    most = F.greatest(F.size(values) - 2, F.lit(0))
    part = lambda k: F.slice(values, k, most)
    return F.zip_with(F.zip_with(part(3), part(2), lambda q, p: q - p * 2.0), part(1), lambda q, p: q + p)


def initial_slope(xs: Column, ys: Column) -> Column:
    """Slope at the first x of the least-squares parabola; null where the points
    do not determine one.  Power sums are centred on the first x."""
    u = F.transform(xs, lambda x: x - F.get(xs, 0))
    power = lambda k: lambda v: F.pow(v, F.lit(float(k)))
    moment = lambda k: lambda v, y: F.pow(v, F.lit(float(k))) * y
    s = [total(F.transform(u, power(k))) for k in range(5)]
    t = [total(F.zip_with(u, ys, moment(k))) for k in range(3)]
    sums = F.struct(*[c.alias(f"s{k}") for k, c in enumerate(s)], *[c.alias(f"t{k}") for k, c in enumerate(t)])

    def solve(p: Column) -> Column:
        s0, s1, s2, s3, s4 = (p[f"s{k}"] for k in range(5))
        t0, t1, t2 = (p[f"t{k}"] for k in range(3))
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        top = s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
        return F.when(F.abs(det) > 1e-30, top / det)

    return F.element_at(F.transform(F.array(sums), solve), 1)


@lru_cache
def savgol_rows(window: int = 11, degree: int = 3) -> tuple[tuple[float, ...], ...]:
    """Projection of ``window`` equally spaced samples on polynomials: row i
    gives the fitted value at sample i.  Solved in fractions, so each coefficient
    is the nearest double."""
    x = [[Fraction(i - window // 2) ** k for k in range(degree + 1)] for i in range(window)]
    # Gauss-Jordan on the normal equations with the samples' powers beside them.
    rows = [[sum(r[i] * r[j] for r in x) for j in range(degree + 1)] + [r[i] for r in x] for i in range(degree + 1)]
    for i, top in enumerate(rows):
        top[:] = [v / top[i] for v in top]
        for other in rows:
            if other is not top:
                other[:] = [v - other[i] * t for v, t in zip(other, top)]
    return tuple(tuple(float(sum(p * rows[k][degree + 1 + j] for k, p in enumerate(r))) for j in range(window)) for r in x)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a column of lists, which of them are known, and where each
    list starts, with the end of the last."""
    flat = column.flatten()
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)]))
    return flat.to_numpy(zero_copy_only=False).astype(float), ~flat.is_null().to_numpy(zero_copy_only=False), ends.astype(np.int64)


def _column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()))


def fill_lists(column: pa.Array, window: int) -> pa.Array:
    """Lists with their nulls filled: linearly between known neighbours, flat beyond
    them; 0 where nothing is known, or where a list is shorter than ``window``."""
    values, known, ends = _lists(column)
    at, size = np.arange(len(values)), np.diff(ends)
    first, last, short = (np.repeat(v, size) for v in (ends[:-1], ends[1:], size < window))
    p = np.maximum.accumulate(np.where(known, at, -1))
    q = np.minimum.accumulate(np.where(known, at, len(values))[::-1])[::-1]
    before, after = p >= first, q < last
    p, q = np.where(before, p, at), np.where(after, q, at)
    made = values[p] + (values[q] - values[p]) * (at - p) / np.maximum(q - p, 1)
    made = np.where(before & after, made, np.where(before, values[p], np.where(after, values[q], 0.0)))
    return _column(np.where(known, values, np.where(short, 0.0, made)), ends)


def means(column: pa.Array) -> pa.Array:
    """Mean of the known values of each list, added in their order; null where
    nothing is known."""
    values, known, ends = _lists(column)
    of = np.repeat(np.arange(len(column)), np.diff(ends))[known]
    count = np.bincount(of, minlength=len(column))
    return pa.array(np.bincount(of, values[known], len(column)) / np.maximum(count, 1), mask=count == 0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows regrouped, so that no group of equal ``keys`` is in two of
    them; with each, where its groups start."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        codes = [batch[k].dictionary_encode("encode").indices.to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
        ends = [tuple(batch[k][i].as_py() for k in keys) for i in (0, len(batch) - 1)]
        if held and ends[0] != last:
            new = np.append(0, new)
        last = ends[1]
        if len(new):
            cut = int(new[-1])
            if rows + cut:
                yield pa.concat_batches([*held, batch.slice(0, cut)]), np.append(0, rows + new[:-1])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += len(batch)
    if held:
        yield pa.concat_batches(held), np.array([0])


def smooth_lists(column: pa.Array, window: int, degree: int = 3) -> pa.Array:
    """Lists smoothed; those shorter than ``window`` stay as they are.  Each stretch of
    samples is multiplied with the whole projection: its middle is a list's inner
    value, its edges are taken where it is a list's first or last one."""
    values, _, ends = _lists(column)
    made, half = values.copy(), window // 2
    long = np.diff(ends) >= window
    if not long.any():
        return column
    rows = np.array(savgol_rows(window, degree)).T.copy()
    # Zeros up to whole tiles of the product, so that all rows of it are added in one order.
    stretches = sliding_window_view(np.pad(values, (0, window - 1 + -len(values) % TILE)), window)
    first, last = ends[:-1][long], ends[1:][long] - window
    inner, edges = np.repeat(long, np.diff(ends)), []
    for low in range(0, len(stretches), STRETCHES):
        fitted = np.ascontiguousarray(stretches[low : low + STRETCHES]) @ rows
        here = slice(low + half, min(low + half + len(fitted), len(values)))
        made[here] = np.where(inner[here], fitted[: here.stop - here.start, half], values[here])
        for at, take in ((first, range(half)), (last, range(half + 1, window))):
            own = at[(at >= low) & (at < low + len(fitted))]
            edges.append((own[:, None] + np.array(take), fitted[own - low][:, take]))
    # Last, over the middles of stretches that reach into the next list.
    for at, fitted in edges:
        made[at] = fitted
    return _column(made, ends)


def fill(values: Column, window: int = 11) -> Column:
    """An array with its nulls filled (``fill_lists``)."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return fill_lists(column, window)

    return run(values)


def smooth(values: Column, window: int = 11, degree: int = 3) -> Column:
    """Savitzky-Golay smoothing of an array without nulls; the ends are fitted on the
    first and last window, and an array shorter than one stays as it is."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return smooth_lists(column, window, degree)

    return run(values)
