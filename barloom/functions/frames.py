"""One vocabulary for the arithmetic of a symbol's daily rows, spoken by Spark columns and by arrays of one symbol.

A definition written as a function of such a vocabulary can be planned as window expressions or computed in one pass over
a symbol's history; both give the same values. A null is a NaN in arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import by_symbol, least_observations, trailing
from barloom.functions.rolling import flag as column_flag


class Columns:
    """Window expressions. rows counts the rows of all trailing frames asked for: what a window operator visits per bar."""

    def __init__(self) -> None:
        self.rows = 0.0

    def __call__(self, value: str | float | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)

    def lag(self, name: str, rows: int = 1) -> Column:
        return F.lag(name, rows).over(by_symbol())

    def ratio(self, a: str | float | Column, b: str | float | Column) -> Column:
        return F.try_divide(self(a), self(b))

    def change(self, name: str, rows: int) -> Column:
        return self.ratio(name, self.lag(name, rows)) - 1

    def fill(self, value: str | Column, other: float) -> Column:
        return F.coalesce(self(value), F.lit(other))

    def when(self, condition: Column, a: Column, b: float) -> Column:
        return F.when(condition, a).otherwise(b)

    def flag(self, condition: Column) -> Column:
        return column_flag(condition)

    def positive(self, value: Column) -> Column:
        return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))

    def abs(self, value: str | Column) -> Column:
        return F.abs(self(value))

    def sign(self, value: str | Column) -> Column:
        return F.signum(self(value))

    def round(self, value: Column, digits: int) -> Column:
        return F.round(value, digits)

    def greatest(self, *values: str | Column) -> Column:
        return F.greatest(*map(self, values))

    def least(self, *values: str | Column) -> Column:
        return F.least(*map(self, values))

    def place(self) -> Column:
        return F.row_number().over(by_symbol()).cast("double")

    def running(self, value: Column) -> Column:
        return F.sum(value).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))

    def streak(self, condition: Column, place: str) -> Column:
        """Rows since the condition last failed; place: the row's number."""
        failed = F.when(self.flag(condition) == 0, F.col(place))
        return F.col(place) - F.coalesce(F.max(failed).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))

    def _frame(self, w: int):
        self.rows += w
        return trailing(w)

    def _over(self, aggregate, value: str | Column, w: int, least: int | None) -> Column:
        frame, value = self._frame(w), self(value)
        return F.when(F.count(value).over(frame) >= (least_observations(w) if least is None else least), aggregate(value).over(frame))

    def mean(self, value: Column, w: int, least: int | None = None) -> Column:
        return self._over(F.avg, value, w, least)

    def sum(self, value: Column, w: int, least: int | None = None) -> Column:
        return self._over(F.sum, value, w, least)

    def std(self, value: Column, w: int) -> Column:
        return self._over(F.stddev_samp, value, w, None)

    def max(self, value: str | Column, w: int) -> Column:
        return self._over(F.max, value, w, None)

    def min(self, value: str | Column, w: int) -> Column:
        return self._over(F.min, value, w, None)

    def quantile(self, value: str | Column, q: float, w: int) -> Column:
        return self._over(lambda x: F.percentile(x, q), value, w, None)

    def _correlation(self, a: Column, b: Column, frame, least: int) -> Column:
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a), F.when(both, b)
        return F.when(F.count(x).over(frame) >= least, F.try_divide(F.covar_samp(x, y).over(frame), F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)))

    def corr(self, a: Column, b: Column, w: int) -> Column:
        """Pearson correlation over the rows where both are known; null without variance."""
        return self._correlation(a, b, self._frame(w), least_observations(w))

    def autocorrelation(self, value: str, previous: str, w: int) -> Column:
        """Correlation of the frame's values with the ones before them, both within the frame."""
        frame = self._frame(w)
        varied = (F.count(value).over(frame) >= least_observations(w)) & (F.max(value).over(frame) > F.min(value).over(frame))
        return F.when(varied, self._correlation(F.col(value), F.col(previous), trailing(w - 1), 2))

    def _still(self, value: str, w: int) -> Column:
        return F.max(value).over(trailing(w)) == F.min(value).over(trailing(w))

    def skew(self, value: str, w: int, least: int) -> Column:
        """Adjusted skewness; 0 without variance."""
        n = F.count(value).over(self._frame(w)).cast("double")
        return F.when(n >= least, F.when(self._still(value, w), 0.0).otherwise(F.skewness(value).over(trailing(w)) * F.sqrt(n * (n - 1)) / (n - 2)))

    def kurt(self, value: str, w: int, least: int) -> Column:
        """Adjusted excess kurtosis; -3 without variance."""
        n = F.count(value).over(self._frame(w)).cast("double")
        return F.when(n >= least, F.when(self._still(value, w), -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value).over(trailing(w)) + 6)))

    def share_of_last(self, name: str, w: int) -> Column:
        """Average rank of the newest value among the frame's, as a share."""
        frame = F.collect_list(name).over(self._frame(w))
        less, same = F.size(F.filter(frame, lambda x: x < F.col(name))), F.size(F.filter(frame, lambda x: x == F.col(name)))
        return F.when(F.col(name).isNotNull() & (F.size(frame) >= least_observations(w)), (less + (same + 1) / 2.0) / F.size(frame))

    def drawdown(self, name: str, w: int) -> Column:
        """The worst fall from the highest value before it, within the frame."""
        values = F.collect_list(name).over(self._frame(w))
        start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("worst"))

        def step(state: Column, x: Column) -> Column:
            top = F.greatest(state["top"], x)
            return F.struct(top.alias("top"), F.least(state["worst"], F.try_divide(x, top) - 1).alias("worst"))

        return F.when(F.size(values) >= least_observations(w), F.aggregate(values, start, step, lambda s: s["worst"]))

    def smooth(self, value: Column, alpha: float, least: int) -> Column:
        """An exponential average has no window expression."""
        self.rows = float("inf")
        return F.lit(None).cast("double")


class _Frames(BaseIndexer):
    """The last window_size rows up to each row, from the first row of its own symbol on."""

    def get_window_bounds(self, num_values: int = 0, min_periods: int | None = None, center: bool | None = None, closed: str | None = None, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        end = np.arange(1, num_values + 1, dtype=np.int64)
        return np.maximum(end - self.window_size, self.first), end


class Arrays:
    """The same on the rows of one symbol in order of date, or of several, one after the other from starts on, each trailing frame in time linear in the rows."""

    def __init__(self, values: dict[str, np.ndarray], starts: Sequence[int] = (0,)) -> None:
        self.values = values
        n = len(next(iter(values.values())))
        self.spans = list(zip(starts, [*starts[1:], n], strict=True))
        self.symbol = np.repeat(np.arange(len(starts)), [b - a for a, b in self.spans])
        self.first = np.asarray(starts, np.int64)[self.symbol]
        self.since = np.arange(n) - self.first
        self._named: set[int] = set()
        self._kept: dict[tuple, np.ndarray] = {}

    def __call__(self, value: str | float | np.ndarray) -> np.ndarray | float:
        if not isinstance(value, str):
            return value
        found = self.values[value]
        self._named.add(id(found))
        return found

    def lag(self, name: str, rows: int = 1) -> np.ndarray:
        return self._earlier(self(name), rows, np.nan)

    def _earlier(self, v: np.ndarray, rows: int, none: float) -> np.ndarray:
        out = np.full(len(v), none)
        if rows < len(v):
            out[rows:] = np.where(self.since[rows:] >= rows, v[:-rows], none)
        return out

    def _each(self, make: Callable[[np.ndarray], np.ndarray], v: np.ndarray) -> np.ndarray:
        return make(v) if len(self.spans) == 1 else np.concatenate([make(v[a:b]) for a, b in self.spans])

    def ratio(self, a: str | float | np.ndarray, b: str | float | np.ndarray) -> np.ndarray:
        b = self(b)
        return self(a) / np.where(b == 0, np.nan, b)

    def change(self, name: str, rows: int) -> np.ndarray:
        return self.ratio(name, self.lag(name, rows)) - 1

    def fill(self, value: str | np.ndarray, other: float) -> np.ndarray:
        return np.where(np.isnan(self(value)), other, self(value))

    def when(self, condition: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
        return np.where(condition, a, b)

    def flag(self, condition: np.ndarray) -> np.ndarray:
        return condition.astype(float)

    def positive(self, value: np.ndarray) -> np.ndarray:
        return np.maximum(value, 0.0)

    def abs(self, value: str | np.ndarray) -> np.ndarray:
        return np.abs(self(value))

    def sign(self, value: str | np.ndarray) -> np.ndarray:
        return np.sign(self(value))

    def round(self, value: np.ndarray, digits: int) -> np.ndarray:
        return np.round(value, digits)

    def greatest(self, *values: str | np.ndarray) -> np.ndarray:
        return np.fmax.reduce([self(v) for v in values])

    def least(self, *values: str | np.ndarray) -> np.ndarray:
        return np.fmin.reduce([self(v) for v in values])

    def place(self) -> np.ndarray:
        return self.since + 1.0

    def running(self, value: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(value), np.nan, self._each(np.cumsum, np.nan_to_num(value)))

    def streak(self, condition: np.ndarray, place: str) -> np.ndarray:
        row = self(place) + self.first
        return row - np.maximum.accumulate(np.where(condition, self.first, row))

    def _rolling(self, value: str | np.ndarray, w: int, least: int | None):
        return pd.Series(self(value)).rolling(w if len(self.spans) == 1 else _Frames(window_size=w, first=self.first), min_periods=least_observations(w) if least is None else least)

    def _over(self, kind: str, value: str | np.ndarray, w: int, least: int | None = None) -> np.ndarray:
        """One statistic of trailing frames; of named values it is computed once. Named arrays live as long as self, so their ids are their own."""
        value = self(value)
        key = (kind, id(value), w, least)
        if key in self._kept:
            return self._kept[key]
        out = getattr(self._rolling(value, w, least), kind)().to_numpy()
        if id(value) in self._named:
            self._kept[key] = out
        return out

    def mean(self, value: np.ndarray, w: int, least: int | None = None) -> np.ndarray:
        return self._over("mean", value, w, least)

    def sum(self, value: np.ndarray, w: int, least: int | None = None) -> np.ndarray:
        return self._over("sum", value, w, least)

    def std(self, value: np.ndarray, w: int) -> np.ndarray:
        return self._over("std", value, w)

    def max(self, value: str | np.ndarray, w: int) -> np.ndarray:
        return self._over("max", value, w)

    def min(self, value: str | np.ndarray, w: int) -> np.ndarray:
        return self._over("min", value, w)

    def quantile(self, value: str | np.ndarray, q: float, w: int) -> np.ndarray:
        return self._rolling(value, w, None).quantile(q).to_numpy()

    def _frame_sums(self, value: np.ndarray, w: int) -> np.ndarray:
        total = self._each(np.cumsum, np.nan_to_num(value))
        return total - self._earlier(total, w, 0.0)

    @staticmethod
    def _standard(v: np.ndarray) -> np.ndarray:
        known = v[~np.isnan(v)]
        return (v - known.mean()) / (known.std() or 1.0) if len(known) else v

    def _correlation(self, a: np.ndarray, b: np.ndarray, w: int, least: int) -> np.ndarray:
        both = ~(np.isnan(a) | np.isnan(b))
        if not both.any():
            return np.full(len(a), np.nan)
        # Centred and scaled first, so that differences of running sums keep their digits.
        x, y = (self._each(self._standard, np.where(both, v, np.nan)) for v in (a, b))
        n, sx, sy = (self._frame_sums(v, w) for v in (both.astype(float), x, y))
        moves = [self._rolling(v, w, 1).max().to_numpy() > self._rolling(v, w, 1).min().to_numpy() for v in (x, y)]
        vx, vy = (np.where(m, self._frame_sums(v * v, w) - t * t / n, 0.0) for m, v, t in zip(moves, (x, y), (sx, sy)))
        scale = np.sqrt(np.maximum(vx, 0.0)) * np.sqrt(np.maximum(vy, 0.0))
        return np.where(n >= least, self.ratio(self._frame_sums(x * y, w) - sx * sy / n, scale), np.nan)

    def corr(self, a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
        return self._correlation(a, b, w, least_observations(w))

    def autocorrelation(self, value: str, previous: str, w: int) -> np.ndarray:
        varied = self.max(value, w) > self.min(value, w)  # unknown below the least number of observations
        return np.where(varied, self._correlation(self(value), self(previous), w - 1, 2), np.nan)

    def skew(self, value: str, w: int, least: int) -> np.ndarray:
        return self._rolling(value, w, least).skew().to_numpy()

    def kurt(self, value: str, w: int, least: int) -> np.ndarray:
        return self._rolling(value, w, least).kurt().to_numpy()

    def share_of_last(self, name: str, w: int) -> np.ndarray:
        return self._rolling(name, w, None).rank(pct=True).to_numpy()

    def drawdown(self, name: str, w: int, block: int = 4096) -> np.ndarray:
        v = self(name)
        padded, out = np.full(len(v) + len(self.spans) * (w - 1), np.nan), np.empty(len(v))
        at = np.arange(len(v)) + self.symbol * (w - 1)  # where a row's frame begins
        padded[at + w - 1] = v
        laid = np.lib.stride_tricks.sliding_window_view(padded, w)
        for a in range(0, len(v), block):  # bounds the memory of the frames laid out
            frames = laid[at[a : a + block]]
            out[a : a + block] = np.fmin.reduce(frames / np.fmax.accumulate(frames, axis=1) - 1, axis=1)
        return np.where(self._rolling(v, w, 1).count().to_numpy() >= least_observations(w), out, np.nan)

    def smooth(self, value: np.ndarray, alpha: float, least: int) -> np.ndarray:
        v = pd.Series(value)
        return (v if len(self.spans) == 1 else v.groupby(self.symbol)).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()
