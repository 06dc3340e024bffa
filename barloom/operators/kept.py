"""Bars written once, a row a bucket of symbols, and gone through as often as blocks of factors need them.

A row holds a bucket's bars in order of symbol and date, each column squeezed, so that a block neither reads the source nor
shuffles bars again. What a date needs is sent to it once, one row for each date and bucket, the values of its bars as bytes;
factors across symbols are made there, from what they rank. Results are those of `vectors`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barloom.operators.factors import ACROSS, BASE, LIQUIDITY_PARTS, NODES, RANKED, _computed, _numbers
from barloom.operators.vectors import _binary, _bucket_means, _expanded, _long, _squeezed, average_ranks, release
from barloom.operators.wide import _order, _sorted, _whole
from barloom.session import cut_lineage

#: A day for a null date, a whole number for a null value.
NO_DAY, NO_VALUE = np.iinfo(np.int32).min, np.iinfo(np.int64).min


def _packed(v: np.ndarray) -> bytes:
    """Doubles, as whole millionths where they are such exactly."""
    with np.errstate(all="ignore"):
        whole = np.rint(v * 1e6)
        exact = np.isnan(v) | ((whole / 1e6 == v) & (np.abs(whole) < 2.0**53) & ~((v == 0) & np.signbit(v)))
    if not exact.all():
        return b"\0" + _squeezed(np.ascontiguousarray(v))
    return b"\1" + _squeezed(np.where(np.isnan(v), NO_VALUE, np.nan_to_num(whole).astype(np.int64)))


def _unpacked(held: bytes, n: int) -> np.ndarray:
    if held[0] == 0:
        return _expanded(held[1:], n)
    whole = _expanded(held[1:], n, np.int64)
    return np.where(whole == NO_VALUE, np.nan, whole / 1e6)


def kept_bars(bars: DataFrame) -> DataFrame:
    """(bucket, n, symbols, starts, date, a column for each value) of bars (the columns of BASE and bucket), a row a bucket; a checkpoint."""

    def pack(group: pa.Table) -> pa.Table:
        group, starts = _sorted(group)
        day = pc.fill_null(group["date"].cast(pa.int32()), NO_DAY).to_numpy()
        one = {"date": _squeezed(day), **{n: _packed(_numbers(group, n)) for n in BASE[2:]}}
        return pa.table({
            "bucket": pa.array([group["bucket"][0].as_py()], pa.int32()),
            "n": pa.array([len(group)], pa.int32()),
            "symbols": pa.array([group["symbol"].take(pa.array(starts)).to_pylist()], pa.list_(pa.string())),
            "starts": _binary([np.array(starts, np.int32).tobytes()]),
            **{n: _binary([v]) for n, v in one.items()},
        })

    schema = "bucket int, n int, symbols array<string>, starts binary, " + ", ".join(f"{n} binary" for n in ("date", *BASE[2:]))
    kept = cut_lineage(bars.select(*BASE, "bucket").groupBy("bucket").applyInArrow(pack, schema))
    release(bars.sparkSession)
    return kept


def opened(batches: Iterator[pa.RecordBatch], wanted: Sequence[str], horizon: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Of each bucket its symbols, where they begin, and by bar the day, the return over the next horizon bars and the wanted factors (all in NODES)."""
    order = _order(wanted)
    for batch in batches:
        for k, n in enumerate(batch["n"].to_pylist()):
            starts = np.frombuffer(batch["starts"][k].as_py(), np.int32)
            values = _computed(order, {c: _unpacked(batch[c][k].as_py(), n) for c in BASE[2:]}, starts.tolist())
            close, label = values["close"], np.full(n, np.nan)
            if n > horizon:
                own = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
                with np.errstate(all="ignore"):
                    label[:-horizon] = np.where(own[horizon:] == own[:-horizon], close[horizon:] / np.where(close[:-horizon] == 0, np.nan, close[:-horizon]) - 1, np.nan)
            yield batch["symbols"][k].as_py(), starts, _expanded(batch["date"][k].as_py(), n, np.int32), label, values


def _across(names: Sequence[str], held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The factors across symbols of a date, from what they need of all its bars."""
    ranked = [n for n in RANKED if n in names or "cs_liquidity_risk_score" in names and n in LIQUIDITY_PARTS]
    out = {}
    with np.errstate(all="ignore"):
        if ranked:
            x = np.stack([_whole(held[RANKED[n][0]], RANKED[n][1]) for n in ranked])
            out = dict(zip(ranked, average_ranks(x) / (~np.isnan(x)).sum(1, keepdims=True), strict=True))
        if "cs_liquidity_risk_score" in names:
            three = np.stack([out[n] for n in LIQUIDITY_PARTS])
            some = (~np.isnan(three)).sum(0)
            a, b, c = np.nan_to_num(three)
            out["cs_liquidity_risk_score"] = np.where(some > 0, (a + b + c) / some, np.nan)
        if "r" in held:
            r = held["r"]
            known = r[~np.isnan(r)]
            out["market_breadth"] = np.full(len(r), (r > 0).mean())
            out["market_mean_return"] = np.full(len(r), known.mean() if len(known) else np.nan)
    return out


Day = Callable[[object, np.ndarray, np.ndarray], pa.Table]


def dated(kept: DataFrame, factors: Sequence[str], horizon: int, found: Day, schema: str, ordered: bool = False) -> DataFrame:
    """What found makes of each date, the matrix of its labelled bars (factors x bars, NaN for null) and their labels; ordered: bars in order of symbol."""
    names = list(factors)
    across = [n for n in names if n in ACROSS]
    parts = [n for n in across if n != "cs_liquidity_risk_score"] + LIQUIDITY_PARTS * ("cs_liquidity_risk_score" in across)
    sources = list(dict.fromkeys([*(n for n in names if n in NODES), *(m for n in parts for m in ACROSS[n][0])]))
    k = len(sources)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, starts, day, label, values in opened(batches, sources, horizon):
            use = np.arange(len(day)) if across else np.flatnonzero(~np.isnan(label))
            by = use[np.argsort(day[use], kind="stable")]
            if not len(by):
                continue
            day = day[by]
            at = np.array([0, *(np.flatnonzero(day[1:] != day[:-1]) + 1), len(day)], np.int64)
            x = np.empty((len(by), k))
            for j, n in enumerate(sources):
                x[:, j] = values[n][by]
            rows = {"x": x, "label": label[by]}
            if ordered:
                code = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(label)))
                rows["symbols"] = np.array([b"\xff" if s is None else s.encode() for s in symbols])[code[by]]
            days = day[at[:-1]]
            for a in range(0, len(days), 1000):
                b = min(a + 1000, len(days))
                cut = {n: v[at[a] : at[b]] for n, v in rows.items()}
                yield pa.record_batch({
                    "date": pa.array(days[a:b], pa.int32(), mask=days[a:b] == NO_DAY).cast(pa.date32()),
                    **{n: pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((at[a : b + 1] - at[a]) * (v.nbytes // len(v))).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(v).tobytes())]) for n, v in cut.items()},
                })

    def met(group: pa.Table) -> pa.Table:
        parts = group["label"].to_pylist()
        label = np.frombuffer(b"".join(parts))
        x = np.ascontiguousarray(np.frombuffer(b"".join(group["x"].to_pylist())).reshape(-1, k).T)
        if across:
            held = dict(zip(sources, x, strict=True))
            held |= _across(across, held)
            known = ~np.isnan(label)
            x, label = np.stack([held[n] for n in names])[:, known], label[known]
        if ordered:
            symbol = np.concatenate([np.frombuffer(s, f"S{len(s) * 8 // len(p)}") for s, p in zip(group["symbols"].to_pylist(), parts, strict=True)])
            order = np.argsort(symbol[known] if across else symbol, kind="stable")
            x, label = x[:, order], label[order]
        return found(group["date"][0].as_py(), x, label)

    columns = "date date, x binary, label binary" + ", symbols binary" * ordered
    return kept.mapInArrow(send, columns).groupBy("date").applyInArrow(met, schema)


def daily_correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x with y, known throughout, over the places where x is known: the correlation and that of ranks, NaN where undefined. Rows known at the same places share the ranks of y."""
    known = ~np.isnan(x)
    ic, rank_ic = np.full((2, len(x)), np.nan)
    alike: dict[bytes, list[int]] = {}
    for i, where in enumerate(known):
        alike.setdefault(where.tobytes(), []).append(i)
    for rows in alike.values():
        where = known[rows[0]]
        if where.sum() < 2:
            continue
        v, label = (x[rows], y) if where.all() else (x[rows][:, where], y[where])
        ic[rows] = _against(v, label)
        rank_ic[rows] = _against(average_ranks(v), average_ranks(label[None, :])[0])
    return ic, rank_ic


def _against(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    moves = (x.max(1) > x.min(1)) & (y.max() > y.min())
    a, b = x - x.mean(1, keepdims=True), y - y.mean()
    with np.errstate(all="ignore"):
        return np.where(moves, (a @ b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(b @ b)), np.nan)


def ic_series(kept: DataFrame, factors: Sequence[str], horizon: int) -> DataFrame:
    names = list(factors)

    def day(date: object, x: np.ndarray, label: np.ndarray) -> pa.Table:
        ic, rank_ic = daily_correlations(x, label)
        return _long(date, names, ~(np.isnan(ic) | np.isnan(rank_ic)), ic=ic, rank_ic=rank_ic)

    return dated(kept, names, horizon, day, "date date, factor string, ic double, rank_ic double")


def quantile_returns(kept: DataFrame, factors: Sequence[str], horizon: int, quantiles: int = 5) -> DataFrame:
    names = [f for f in factors for _ in range(quantiles)]
    number = np.tile(np.arange(1, quantiles + 1, dtype=np.int32), len(factors))

    def day(date: object, x: np.ndarray, label: np.ndarray) -> pa.Table:
        count, mean = _bucket_means(x, label, quantiles)
        return _long(date, names, count > 0, quantile=number, mean_forward_return=mean)

    return dated(kept, factors, horizon, day, "date date, factor string, quantile int, mean_forward_return double", ordered=True)


def with_codes(codes: dict, factors: Sequence[str], horizon: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Factors (all in NODES) by bar, labels and codes of kept buckets, where label and code are known. codes: code by date."""
    days, own = _days_codes(codes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, _, day, label, values in opened(batches, factors, horizon):
            at = np.minimum(np.searchsorted(days, day), max(0, len(days) - 1))
            use = np.flatnonzero((days[at] == day) & ~np.isnan(label)) if len(days) else np.empty(0, np.int64)
            if len(use):
                yield np.stack([values[n][use] for n in factors]), label[use], own[at[use]]

    return read


def _days_codes(codes: dict) -> tuple[np.ndarray, np.ndarray]:
    days = np.array(list(codes), "datetime64[D]").astype(np.int32)
    order = np.argsort(days)
    return days[order], np.array(list(codes.values()), np.uint8)[order]


def packed_dates(kept: DataFrame, codes: dict, factors: Sequence[str], horizon: int) -> DataFrame:
    """As vectors.packed_columns, a date a row: for factors across symbols."""
    names = list(factors)

    def day(date: object, x: np.ndarray, label: np.ndarray) -> pa.Table:
        use = date in codes and len(label) > 0
        one = {"code": np.full(len(label), codes[date], np.uint8), "label": label, **dict(zip(names, x, strict=True))} if use else {}
        return pa.table({"n": pa.array([len(label)] * use, pa.int32()), **{n: _binary([_squeezed(np.ascontiguousarray(one[n]))] * use if use else []) for n in ("code", "label", *names)}})

    return dated(kept, names, horizon, day, "n int, " + ", ".join(f"`{n}` binary" for n in ("code", "label", *names)))
