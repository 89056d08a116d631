"""Guarded windows over a dense panel: an aggregate is null unless its frame holds enough values."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("series",))).orderBy("period")


def rolling(n: int, *keys: str) -> WindowSpec:
    return by_series(*keys).rowsBetween(-(n - 1), 0)


def expanding(*keys: str) -> WindowSpec:
    return by_series(*keys).rowsBetween(Window.unboundedPreceding, 0)


def past(*keys: str) -> WindowSpec:
    """Rows strictly before the current one."""
    return by_series(*keys).rowsBetween(Window.unboundedPreceding, -1)


def guarded(aggregate: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(value).over(frame) >= least, aggregate.over(frame))


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def mean(v: Column, frame: WindowSpec, least: int = 1) -> Column:
    return guarded(F.avg(v), v, frame, least)


def sd(v: Column, frame: WindowSpec, least: int = 2) -> Column:
    return guarded(F.stddev_samp(v), v, frame, max(2, least))


def quantile(v: Column, q: float, frame: WindowSpec, least: int = 1) -> Column:
    """Exact, linearly interpolated."""
    return guarded(F.percentile(v, F.lit(q)), v, frame, least)


def zscore(v: Column, frame: WindowSpec, least: int = 2) -> Column:
    return (v - mean(v, frame, least)) / nonzero(sd(v, frame, least))


def minmax(v: Column, frame: WindowSpec, least: int = 1) -> Column:
    low, high = guarded(F.min(v), v, frame, least), guarded(F.max(v), v, frame, least)
    return (v - low) / nonzero(high - low)


def robust(v: Column, frame: WindowSpec, least: int = 1) -> Column:
    spread = quantile(v, 0.75, frame, least) - quantile(v, 0.25, frame, least)
    return (v - quantile(v, 0.5, frame, least)) / nonzero(spread)


def forward_fill(v: Column, *keys: str) -> Column:
    return F.last(v, ignorenulls=True).over(expanding(*keys))


def backward_fill(v: Column, *keys: str) -> Column:
    return F.first(v, ignorenulls=True).over(by_series(*keys).rowsBetween(0, Window.unboundedFollowing))


def average_rank(v: Column, *keys: str) -> Column:
    """Ties share the mean of their ranks; nulls have none."""
    frame = Window.partitionBy(*keys, v.isNull())
    low = F.rank().over(frame.orderBy(v))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), low + (ties - 1) / 2.0)


def expanding_below(v: Column, *keys: str) -> tuple[Column, Column, Column]:
    """(values below, values equal, values) up to the current row, itself included.

    The history of one series is gathered in an array: series are periodic, so it has one entry a period."""
    seen = F.collect_list(v).over(expanding(*keys))
    return F.size(F.filter(seen, lambda x: x < v)), F.size(F.filter(seen, lambda x: x == v)), F.size(seen)


def percentile_rank(v: Column, least: int = 2, *keys: str) -> Column:
    """0 to 100: place of the current value among all so far, ties in the middle."""
    below, equal, n = expanding_below(v, *keys)
    return F.when(v.isNotNull() & (n >= least) & (n > 1), (below + (equal + 1) / 2.0 - 1) / (n - 1) * 100)


def quintile(v: Column, least: int = 60, *keys: str) -> Column:
    """1 to 5 by the lowest rank among all values so far; null before `least` of them."""
    below, _, n = expanding_below(v, *keys)
    return F.when(v.isNotNull() & (n >= least) & (n > 1), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(below / (n - 1) * 5).cast("int") + 1)))


def drawdown(v: Column, *keys: str) -> Column:
    top = F.max(v).over(expanding(*keys))
    return (v - top) / nonzero(top)
