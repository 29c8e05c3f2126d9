"""Window expressions that replace row loops."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def full(value: Column, aggregate: Column, frame: WindowSpec, n: int) -> Column:
    """A window aggregate that is null unless all ``n`` values of the frame are present."""
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))


def rolling_mean(value: Column, w: WindowSpec, n: int) -> Column:
    """Mean of the ``n`` rows before the current one."""
    return full(value, F.avg(value), w.rowsBetween(-n, -1), n)


def rolling_sum(value: Column, w: WindowSpec, n: int) -> Column:
    return full(value, F.sum(value), w.rowsBetween(-n, -1), n)


def ratio_to(value: Column, base: Column, floor: float) -> Column:
    """value / max(base, floor), null where the base is."""
    return F.when(base.isNotNull(), value / F.greatest(base, F.lit(floor)))


def rows_since(event: Column, w: WindowSpec, start: int, cap: int) -> Column:
    """Rows since ``event`` was last true (0 on such a row), counting on from ``start`` before the first, capped."""
    n = F.row_number().over(w)
    last = F.max(F.when(event, n)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.least(F.when(last.isNotNull(), n - last).otherwise(start + n), F.lit(cap))


def run_length(inside: Column, w: WindowSpec, cap: int) -> Column:
    """Consecutive rows, up to the current one, on which ``inside`` holds."""
    n = F.row_number().over(w)
    broken = F.max(F.when(~inside, n)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.least(n - F.coalesce(broken, F.lit(0)), F.lit(cap))


def past_z(value: Column, frame: WindowSpec, spread: Column, least_sd: float, least_n: int = 1) -> Column:
    """Distance from the mean of a frame in standard deviations of that frame."""
    mean, n = F.avg(value).over(frame), F.count(value).over(frame)
    sd = spread.over(frame)
    return F.when((n >= least_n) & (sd > least_sd), (value - mean) / sd)


def clip(value: Column, low: float, high: float) -> Column:
    """Clipped value, null where the value is null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
