"""Small column expressions used across operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become NULL, done once where data enters."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_corr(a, b) -> Column:
    """Population Pearson correlation as an aggregate; NULL where either side does not vary."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def rmse(a, b) -> Column:
    """Root of the mean squared difference, as an aggregate."""
    d = col(a) - col(b)
    return F.sqrt(F.avg(d * d))


def wind_speed(u, v) -> Column:
    return F.hypot(col(u), col(v))


def wind_from_direction(u, v) -> Column:
    """Direction the wind comes from, degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(col(v), col(u))), F.lit(360.0))


def geopotential_height(z) -> Column:
    # Fixed value: standard gravity used for geopotential to metres.
    return F.coalesce(col(z), F.lit(0.0)) / F.lit(9.80665)


def wrap_longitude(lon) -> Column:
    """Degrees east in any convention to [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def log10_1p(c) -> Column:
    return F.log10(col(c) + 1.0)


def day_number(c) -> Column:
    return F.unix_date(F.to_date(col(c)))


def digamma(x) -> Column:
    """psi(x) for x > 0: recurrence up to x + 6, then the asymptotic series (error below 1e-9)."""
    x = col(x)
    y = x + 6.0
    lift = sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)
    inv2 = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240))))
    return series - lift


def trigamma(x) -> Column:
    """psi'(x) for x > 0, same method as :func:`digamma`."""
    x = col(x)
    y = x + 6.0
    lift = sum((1.0 / ((x + float(i)) * (x + float(i))) for i in range(1, 6)), 1.0 / (x * x))
    inv = 1.0 / y
    inv2 = inv * inv
    return lift + inv + inv2 / 2.0 + inv2 * inv * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30))))


def count_le(xs, x, bits: int = 13) -> Column:
    """How many entries of the ascending array ``xs`` are <= x, by binary search.

    The search takes ``bits`` steps; an array of 2**bits entries or more raises an error.
    """
    xs, x = col(xs), col(x)
    steps = F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda acc, s: F.when((acc + s <= F.size(xs)) & (F.try_element_at(xs, acc + s) <= x), acc + s).otherwise(acc),
    )
    return F.when(F.size(xs) < 1 << bits, found).when(xs.isNotNull(), F.raise_error(F.lit(f"array of {1 << bits} entries or more: search with more bits")).cast("int"))


def interpolate(x, xs, ys, index) -> Column:
    """Piecewise linear value at ``x`` through the nodes (xs, ys), both ascending arrays of equal length.

    ``index`` is ``count_le(xs, x)``; keep it in a column of its own, so that it is searched once per row.
    Beyond the first or last node the offset of that node is kept: y_end + (x - x_end). NULL gives NULL.
    """
    x, xs, ys = col(x), col(xs), col(ys)
    n = F.size(xs)
    k = F.greatest(F.lit(1), F.least(col(index), n - 1))
    x0, x1 = F.try_element_at(xs, k), F.try_element_at(xs, k + 1)
    y0, y1 = F.try_element_at(ys, k), F.try_element_at(ys, k + 1)
    inside = y0 + F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0)) * (y1 - y0)
    first_x, last_x = F.try_element_at(xs, F.lit(1)), F.try_element_at(xs, n)
    first_y, last_y = F.try_element_at(ys, F.lit(1)), F.try_element_at(ys, n)
    return (
        F.when(x.isNull(), None)
        .when(x < first_x, first_y + (x - first_x))
        .when(x >= last_x, last_y + (x - last_x))
        .otherwise(inside)
    )


def interpolate_each(targets, xs, ys, bits: int = 13) -> Column:
    """:func:`interpolate` for every entry of the array ``targets``."""
    located = F.transform(col(targets), lambda y: F.struct(y.alias("y"), count_le(xs, y, bits).alias("k")))
    return F.transform(located, lambda s: interpolate(s["y"], xs, ys, s["k"]))
