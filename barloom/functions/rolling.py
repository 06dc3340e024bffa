"""Windowed arithmetic on daily rows: frames count trading rows of a symbol, and too few observations give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def trailing(rows: int) -> WindowSpec:
    return by_symbol().rowsBetween(1 - rows, 0)


def least_observations(rows: int) -> int:
    """Observations a frame of so many rows needs: four fifths of a short one, two thirds of a long one."""
    return max(3, rows * 4 // 5) if rows <= 10 else max(10, rows * 67 // 100)


def rolling(aggregate: Callable[[Column], Column], value: Column, rows: int, least: int | None = None) -> Column:
    frame = trailing(rows)
    need = least_observations(rows) if least is None else least
    return F.when(F.count(value).over(frame) >= need, aggregate(value).over(frame))


def roll_mean(value: Column, rows: int, least: int | None = None) -> Column:
    return rolling(F.avg, value, rows, least)


def roll_sum(value: Column, rows: int, least: int | None = None) -> Column:
    return rolling(F.sum, value, rows, least)


def roll_std(value: Column, rows: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, value, rows, least)


def roll_corr(a: Column, b: Column, rows: int) -> Column:
    """Pearson correlation over the rows where both are known; null without variance."""
    frame = trailing(rows)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    scale = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
    return F.when(F.count(x).over(frame) >= least_observations(rows), F.try_divide(F.covar_samp(x, y).over(frame), scale))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; unknown counts as 0.0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rank_average(value: Column, *groups: str) -> Column:
    """Rank from 1 with ties averaged; null for null values. Nulls must sort last, as they do here."""
    order = Window.partitionBy(*groups).orderBy(value.asc_nulls_last())
    # Rows up to and including the ties: with the rank, the first and last place of the ties, from one sort.
    last = F.count(value).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(order) + last) / 2.0)


def rank_share(value: Column, *groups: str) -> Column:
    """Average rank as a share of the known values of the group."""
    return rank_average(value, *groups) / F.count(value).over(Window.partitionBy(*groups))


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate that is null, not an error, where either side is constant. x and y: double columns."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
