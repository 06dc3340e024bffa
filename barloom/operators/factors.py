"""The factor panel: a registry of named definitions, computed by symbol and then across symbols.

Asking for some factors plans only what these need. Definitions by symbol are written once, in the vocabulary of
functions.frames. Where their trailing frames are short they become window expressions, in as few stages as their
dependencies allow, so that Spark sorts each symbol once per stage. A window operator visits every row of a frame for
every bar, though; where frames add up to more than LONG_FRAMES rows, or an exponential average is needed, one grouped
Arrow pass per symbol computes everything by symbol in time linear in its bars, which its trading calendar bounds.
Ranks and means across symbols are windows by date in either case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import Arrays, Columns
from barloom.functions.rolling import flag, least_observations, rank_share

BASE = ("date", "symbol", "open", "high", "low", "close", "volume", "amount", "turnover")
LONG_FRAMES = 100

#: Definitions by symbol and across symbols: name -> (names needed, definition).
NODES: dict[str, tuple[tuple[str, ...], Callable]] = {}
ACROSS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {}
FACTORS: list[str] = []
#: Of the factors across symbols, the ranks: name -> (what is ranked by date, digits to which it ties).
RANKED: dict[str, tuple[str, int]] = {}
LIQUIDITY_PARTS = ["cs_volatility_rank_20", "cs_turnover_rank_20", "cs_amount_rank_20"]


def helper(name: str, needs: Iterable[str], make: Callable) -> None:
    NODES[name] = (tuple(needs), make)


def factor(name: str, needs: Iterable[str], make: Callable) -> None:
    helper(name, needs, make)
    FACTORS.append(name)


def across(name: str, needs: Iterable[str], make: Callable[[], Column]) -> None:
    ACROSS[name] = (tuple(needs), make)
    FACTORS.append(name)


def _returns() -> None:
    helper("pc", [], lambda o: o.lag("close"))
    helper("r", [], lambda o: o.change("close", 1))
    helper("r0", ["r"], lambda o: o.fill("r", 0.0))
    helper("r_prev", ["r"], lambda o: o.lag("r"))
    helper("r_abs", ["r"], lambda o: o.abs("r"))
    helper("r_down", ["r"], lambda o: o.when(o("r") < 0, o("r"), 0.0))
    helper("r_up", ["r"], lambda o: o.when(o("r") > 0, o("r"), 0.0))
    for w in (1, 2, 3, 5, 10, 20, 40, 60, 120, 240):
        factor(f"momentum_{w}", [], lambda o, w=w: o.change("close", w))
    for w in (1, 2, 3, 5, 10, 20):
        factor(f"reversal_{w}", [f"momentum_{w}"], lambda o, w=w: -o(f"momentum_{w}"))
    for w in (5, 10, 20, 40, 60, 120, 240):
        factor(f"volatility_{w}", ["r"], lambda o, w=w: o.std(o("r"), w))
    for w in (5, 10, 20, 60, 120):
        factor(f"downside_volatility_{w}", ["r_down"], lambda o, w=w: o.std(o("r_down"), w))
    for w in (5, 10, 20, 60):
        factor(f"upside_volatility_{w}", ["r_up"], lambda o, w=w: o.std(o("r_up"), w))
    for w in (20, 60, 120):
        factor(f"max_drawdown_{w}", [], lambda o, w=w: o.drawdown("close", w))


def _averages() -> None:
    for w in (5, 10, 20, 40, 60, 120, 240):
        helper(f"ma_{w}", [], lambda o, w=w: o.mean(o("close"), w))
        factor(f"ma_bias_{w}", [f"ma_{w}"], lambda o, w=w: o.ratio(o("close"), o(f"ma_{w}")) - 1)
    for w in (5, 10, 20, 60):
        factor(f"ma_slope_{w}", [f"ma_{w}"], lambda o, w=w: o.change(f"ma_{w}", w))
    for w in (5, 10, 12, 20, 26, 60, 120):
        helper(f"ema_{w}", [], lambda o, w=w: o.smooth(o("close"), 2 / (w + 1), least_observations(w)))
        factor(f"ema_bias_{w}", [f"ema_{w}"], lambda o, w=w: o.ratio(o("close"), o(f"ema_{w}")) - 1)
    for w in (12, 26, 60):
        factor(f"ema_slope_{w}", [f"ema_{w}"], lambda o, w=w: o.change(f"ema_{w}", w))
    helper("macd_raw", ["ema_12", "ema_26"], lambda o: o("ema_12") - o("ema_26"))
    helper("macd_smooth", ["macd_raw"], lambda o: o.smooth(o("macd_raw"), 0.2, 6))
    factor("macd_diff", ["macd_raw"], lambda o: o.ratio(o("macd_raw"), o("close")))
    factor("macd_signal", ["macd_smooth"], lambda o: o.ratio(o("macd_smooth"), o("close")))
    factor("macd_hist", ["macd_raw", "macd_smooth"], lambda o: o.ratio(o("macd_raw") - o("macd_smooth"), o("close")))


def _oscillators() -> None:
    helper("gain", ["r"], lambda o: o.positive(o("r")))
    helper("loss", ["r"], lambda o: o.positive(-o("r")))
    for w in (6, 14, 24):
        factor(f"rsi_{w}", ["gain", "loss"], lambda o, w=w: 100 - o.ratio(100.0, 1 + o.ratio(o.mean(o("gain"), w), o.mean(o("loss"), w))))
    helper("stochastic", ["hh_20", "ll_20"], lambda o: 100 * o.ratio(o("close") - o("ll_20"), o("hh_20") - o("ll_20")))
    factor("kdj_k_9", ["stochastic"], lambda o: o.smooth(o("stochastic"), 1 / 3, 6))
    factor("kdj_d_9", ["kdj_k_9"], lambda o: o.smooth(o("kdj_k_9"), 1 / 3, 6))
    factor("kdj_j_9", ["kdj_k_9", "kdj_d_9"], lambda o: 3 * o("kdj_k_9") - 2 * o("kdj_d_9"))
    helper("tp", [], lambda o: (o("high") + o("low") + o("close")) / 3)
    for w in (14, 20):
        helper(f"tp_dev_{w}", ["tp"], lambda o, w=w: o("tp") - o.mean(o("tp"), w))
        factor(f"cci_{w}", [f"tp_dev_{w}"], lambda o, w=w: o.ratio(o(f"tp_dev_{w}"), 0.015 * o.mean(o.abs(f"tp_dev_{w}"), w)))
        factor(f"williams_r_{w}", [], lambda o, w=w: o.ratio(-100 * (o.max("high", w) - o("close")), o.max("high", w) - o.min("low", w)))
        helper("tp_step", ["tp"], lambda o: o("tp") - o.lag("tp"))
        helper("flow_in", ["tp_step"], lambda o: o.when(o("tp_step") > 0, o("tp") * o("volume"), 0.0))
        helper("flow_out", ["tp_step"], lambda o: o.when(o("tp_step") < 0, o("tp") * o("volume"), 0.0))
        factor(f"money_flow_index_{w}", ["flow_in", "flow_out"], lambda o, w=w: 100 - o.ratio(100.0, 1 + o.ratio(o.sum(o("flow_in"), w), o.sum(o("flow_out"), w))))


def _positions() -> None:
    for w in (20, 40, 60, 120, 240):
        helper(f"hh_{w}", [], lambda o, w=w: o.max("high", w))
        helper(f"ll_{w}", [], lambda o, w=w: o.min("low", w))
        both = [f"hh_{w}", f"ll_{w}"]
        factor(f"price_position_{w}", both, lambda o, w=w: o.ratio(o("close") - o(f"ll_{w}"), o(f"hh_{w}") - o(f"ll_{w}")))
        factor(f"breakout_high_{w}", both, lambda o, w=w: o.ratio(o("close"), o(f"hh_{w}")) - 1)
        factor(f"breakdown_low_{w}", both, lambda o, w=w: o.ratio(o("close"), o(f"ll_{w}")) - 1)
    for w in (20, 60, 120):
        factor(f"close_to_high_{w}", [f"breakout_high_{w}"], lambda o, w=w: o(f"breakout_high_{w}"))
        factor(f"close_to_low_{w}", [f"breakdown_low_{w}"], lambda o, w=w: o(f"breakdown_low_{w}"))
    factor("new_high_distance_60", ["breakout_high_60"], lambda o: o("breakout_high_60"))
    factor("new_low_distance_60", ["breakdown_low_60"], lambda o: o("breakdown_low_60"))


def _liquidity() -> None:
    for what in ("amount", "turnover"):
        for w in (5, 10, 20, 40, 60, 120):
            factor(f"{what}_mean_{w}", [], lambda o, what=what, w=w: o.mean(o(what), w))
        for w in (20, 60):
            factor(f"{what}_zscore_{w}", [], lambda o, what=what, w=w: o.ratio(o(what) - o.mean(o(what), w), o.std(o(what), w)))
            factor(f"{what}_percentile_{w}", [], lambda o, what=what, w=w: o.share_of_last(what, w))
    for what in ("volume", "amount"):
        factor(f"{what}_ratio_5_20", [], lambda o, what=what: o.ratio(o.mean(o(what), 5, 5), o.mean(o(what), 20, 15)) - 1)
        factor(f"{what}_ratio_10_60", [], lambda o, what=what: o.ratio(o.mean(o(what), 10, 8), o.mean(o(what), 60, 40)) - 1)
    for w in (5, 20, 60):
        factor(f"vwap_bias_{w}", [], lambda o, w=w: o.ratio(o("close"), o.ratio(o.sum(o("amount"), w), o.sum(o("volume"), w))) - 1)
    helper("obv", ["r0"], lambda o: o.running(o.sign("r0") * o("volume")))
    # Rounded, so that a total which is zero but for the last bits is zero, not a tiny divisor.
    helper("pvt", ["r0"], lambda o: o.round(o.running(o("r0") * o("volume")), 6))
    helper("amount_change", [], lambda o: o.change("amount", 1))
    for w in (20, 60):
        factor(f"obv_slope_{w}", ["obv"], lambda o, w=w: o.change("obv", w))
        factor(f"volume_price_corr_{w}", [], lambda o, w=w: o.corr(o("volume"), o("close"), w))
        factor(f"return_amount_corr_{w}", ["r", "amount_change"], lambda o, w=w: o.corr(o("r"), o("amount_change"), w))
        factor(f"amount_shock_count_{w}", [f"amount_zscore_{w}"], lambda o, w=w: o.sum(o.flag(o(f"amount_zscore_{w}") > 1.5), w))
        factor(f"signed_volume_flow_{w}", ["r0"], lambda o, w=w: o.ratio(o.sum(o.sign("r0") * o("amount"), w), o.sum(o("amount"), w)))
        factor(f"price_volume_trend_{w}", ["pvt"], lambda o, w=w: o.change("pvt", w))
        factor(f"amihud_illiquidity_{w}", ["r_abs"], lambda o, w=w: o.mean(o.ratio(o("r_abs"), o("amount")), w, {20: 15, 60: 40}[w]))
        for what in ("volume", "amount", "turnover"):
            factor(f"{what}_cv_{w}", [], lambda o, what=what, w=w: o.ratio(o.std(o(what), w), o.mean(o(what), w)))
        for what in ("amount", "turnover"):
            factor(f"{what}_crowding_{w}", [f"{what}_percentile_{w}", f"volatility_{w}"], lambda o, what=what, w=w: o(f"{what}_percentile_{w}") * o(f"volatility_{w}"))


def _candles() -> None:
    factor("intraday_return", [], lambda o: o.ratio(o("close"), o("open")) - 1)
    for name in ("overnight_return", "gap_return"):
        factor(name, ["pc"], lambda o: o.ratio(o("open"), o("pc")) - 1)
    factor("amplitude", ["pc"], lambda o: o.ratio(o("high") - o("low"), o("pc")))
    helper("tr", ["pc"], lambda o: o.greatest(o("high") - o("low"), o.abs(o("high") - o("pc")), o.abs(o("low") - o("pc"))))
    for w in (5, 10, 20, 60):
        factor(f"atr_pct_{w}", ["tr"], lambda o, w=w: o.ratio(o.mean(o("tr"), w), o("close")))
        factor(f"amplitude_mean_{w}", ["amplitude"], lambda o, w=w: o.mean(o("amplitude"), w))
    span = lambda o: o("high") - o("low")
    factor("close_position", [], lambda o: o.ratio(o("close") - o("low"), span(o)))
    factor("upper_shadow", [], lambda o: o.ratio(o("high") - o.greatest("open", "close"), span(o)))
    factor("lower_shadow", [], lambda o: o.ratio(o.least("open", "close") - o("low"), span(o)))
    factor("body_size", [], lambda o: o.ratio(o.abs(o("close") - o("open")), span(o)))
    for w in (20, 60):
        factor(f"amplitude_zscore_{w}", ["amplitude", f"amplitude_mean_{w}"], lambda o, w=w: o.ratio(o("amplitude") - o(f"amplitude_mean_{w}"), o.std(o("amplitude"), w)))
        helper(f"close_std_{w}", [], lambda o, w=w: o.std(o("close"), w))
        factor(f"bollinger_zscore_{w}", [f"ma_{w}", f"close_std_{w}"], lambda o, w=w: o.ratio(o("close") - o(f"ma_{w}"), o(f"close_std_{w}")))
        factor(f"bollinger_width_{w}", [f"ma_{w}", f"close_std_{w}"], lambda o, w=w: o.ratio(4 * o(f"close_std_{w}"), o(f"ma_{w}")))
        factor(f"bollinger_breakout_count_{w}", [f"bollinger_zscore_{w}"], lambda o, w=w: o.sum(o.flag(o(f"bollinger_zscore_{w}") > 2), w))
        for side, cut in (("up", 0.02), ("down", -0.02)):
            factor(f"gap_{side}_count_{w}", ["gap_return"], lambda o, side=side, cut=cut, w=w: o.sum(o.flag(o("gap_return") > cut if side == "up" else o("gap_return") < cut), w))
        for side in ("upper", "lower"):
            factor(f"long_{side}_shadow_count_{w}", [f"{side}_shadow"], lambda o, side=side, w=w: o.sum(o.flag(o(f"{side}_shadow") > 0.55), w))
        factor(f"positive_body_ratio_{w}", [], lambda o, w=w: o.mean(o.flag(o("close") > o("open")), w))
        factor(f"range_compression_{w}", [f"amplitude_mean_{w}", "amplitude_mean_60"], lambda o, w=w: o.ratio(o(f"amplitude_mean_{w}"), o("amplitude_mean_60")))
    factor("atr_contraction_20_60", ["atr_pct_20", "atr_pct_60"], lambda o: o.ratio(o("atr_pct_20"), o("atr_pct_60")))


def _shapes() -> None:
    for w, least in ((20, 15), (60, 40)):
        factor(f"return_skew_{w}", ["r"], lambda o, w=w, least=least: o.skew("r", w, least))
        factor(f"return_kurt_{w}", ["r"], lambda o, w=w, least=least: o.kurt("r", w, least))
        factor(f"limit_up_count_{w}", ["r"], lambda o, w=w: o.sum(o.flag(o("r") >= 0.095), w, 1))
        factor(f"limit_down_count_{w}", ["r"], lambda o, w=w: o.sum(o.flag(o("r") <= -0.095), w, 1))
        factor(f"up_day_ratio_{w}", ["r"], lambda o, w=w, least=least: o.mean(o.flag(o("r") > 0), w, least))
        factor(f"down_day_ratio_{w}", ["r"], lambda o, w=w, least=least: o.mean(o.flag(o("r") < 0), w, least))
        factor(f"return_autocorr_{w}", ["r", "r_prev"], lambda o, w=w: o.autocorrelation("r", "r_prev", w))
        factor(f"downside_tail_return_{w}", ["r"], lambda o, w=w: o.quantile("r", 0.1, w))
        factor(f"upside_tail_return_{w}", ["r"], lambda o, w=w: o.quantile("r", 0.9, w))
        factor(f"return_abs_mean_{w}", ["r_abs"], lambda o, w=w: o.mean(o("r_abs"), w))
        factor(f"close_above_ma_ratio_{w}", [f"ma_{w}"], lambda o, w=w: o.mean(o.flag(o("close") > o(f"ma_{w}")), w))
        factor(
            f"shrinkage_breakout_{w}",
            [f"breakout_high_{w}", f"volume_cv_{w}"],
            lambda o, w=w: o.flag(o(f"breakout_high_{w}") > -0.01) * o.flag(o(f"volume_cv_{w}") < o.quantile(f"volume_cv_{w}", 0.5, w) - 1e-12),
        )
        factor(f"stalled_up_volume_{w}", ["r", f"amount_zscore_{w}"], lambda o, w=w: o.sum(o.flag((o("r") > 0) & (o("r") < 0.01) & (o(f"amount_zscore_{w}") > 1)), w))
        factor(f"low_volume_pullback_{w}", ["r", f"amount_zscore_{w}"], lambda o, w=w: o.sum(o.flag((o("r") < 0) & (o(f"amount_zscore_{w}") < -0.5)), w))
        factor(f"volatility_contraction_{w}", [f"volatility_{w}", "volatility_120"], lambda o, w=w: o.ratio(o(f"volatility_{w}"), o("volatility_120")))
    factor("limit_up_near_5", ["r"], lambda o: o.sum(o.flag(o("r") >= 0.075), 5, 1))
    factor("limit_down_near_5", ["r"], lambda o: o.sum(o.flag(o("r") <= -0.075), 5, 1))
    for kind in ("ma", "ema"):
        parts = [f"{kind}_{w}" for w in (5, 10, 20, 60)]
        factor(f"{kind}_alignment_score", parts, lambda o, parts=parts: sum((o.flag(o(a) > o(b)) for a, b in zip(parts, parts[1:])), 0.0) / 3)
    for w in (20, 60, 120):
        factor(f"price_efficiency_{w}", [f"momentum_{w}", "r_abs"], lambda o, w=w: o.ratio(o.abs(f"momentum_{w}"), o.sum(o("r_abs"), w)))
        factor(f"trend_strength_{w}", [f"momentum_{w}", f"volatility_{w}"], lambda o, w=w: o.ratio(o.abs(f"momentum_{w}"), o(f"volatility_{w}")))
    helper("row_place", [], lambda o: o.place())
    for side, sign in (("up", 1), ("down", -1)):
        factor(f"{side}_streak", ["row_place", "r"], lambda o, sign=sign: o.streak(sign * o("r") > 0, "row_place"))


def _cross_section() -> None:
    sources = {"momentum_rank_20": "momentum_20", "momentum_rank_60": "momentum_60", "momentum_rank_120": "momentum_120", "reversal_rank_5": "reversal_5", "volatility_rank_20": "volatility_20", "volatility_rank_60": "volatility_60"}
    sources |= {f"{what}_rank_{w}": f"{what}_mean_{w}" for what in ("amount", "turnover") for w in (20, 60)}
    for name, source in sources.items():
        # Rounded, so that means which differ only by the order of summation tie.
        RANKED[f"cs_{name}"] = (source, digits := 5 if source.startswith("amount") else 9)
        across(f"cs_{name}", [source], lambda source=source, digits=digits: rank_share(F.round(source, digits), "date"))
    parts = LIQUIDITY_PARTS
    known = lambda p: F.when(F.col(p).isNotNull(), 1).otherwise(0)
    across("cs_liquidity_risk_score", parts, lambda: F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), sum((known(p) for p in parts), F.lit(0))))
    across("market_breadth", ["r"], lambda: F.avg(flag(F.col("r") > 0)).over(Window.partitionBy("date")))
    across("market_mean_return", ["r"], lambda: F.avg("r").over(Window.partitionBy("date")))


for _family in (_returns, _averages, _oscillators, _positions, _liquidity, _candles, _shapes, _cross_section):
    _family()


def _stages(wanted: Iterable[str], nodes: dict[str, tuple[tuple[str, ...], Callable]]) -> list[list[str]]:
    """What of nodes is needed for the wanted ones, in stages: each needs only earlier ones."""
    level: dict[str, int] = {}

    def place(name: str) -> int:
        if name not in nodes:
            return 0
        if name not in level:
            level[name] = 1 + max((place(n) for n in nodes[name][0]), default=0)
        return level[name]

    for name in wanted:
        place(name)
    return [sorted(n for n in level if level[n] == step) for step in range(1, max(level.values(), default=0) + 1)]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].cast(pa.float64()).to_numpy()  # null becomes NaN


def _values(order: list[str], table: pa.Table, starts: Iterable[int] = (0,)) -> dict[str, np.ndarray]:
    return _computed(order, {n: _numbers(table, n) for n in BASE[2:]}, starts)


def _computed(order: list[str], values: dict[str, np.ndarray], starts: Iterable[int]) -> dict[str, np.ndarray]:
    """values, which hold the columns of BASE, and what order adds to them."""
    rows, ops = len(values["close"]), Arrays(values, list(starts))
    with np.errstate(all="ignore"):
        for name in order:
            values[name] = np.broadcast_to(NODES[name][1](ops), rows)
    return values


def _pass(order: list[str], table: pa.Table, more: dict[str, np.ndarray], keep: list[str], out: list[str]) -> pa.Table:
    values = _values(order, table) | more
    return pa.table({**{n: table[n] for n in keep}, **{n: pa.array(values[n], from_pandas=True) for n in out}})


def _schema(df: DataFrame, keep: list[str], out: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"{n} {kinds[n]}" for n in keep), *(f"{n} double" for n in out)])


def by_symbol_pass(bars: DataFrame, stages: list[list[str]], keep: list[str], out: list[str]) -> DataFrame:
    """keep and out of every bar, from one grouped pass per symbol."""
    order, narrow = [name for stage in stages for name in stage], bars.select(*BASE)
    compute = lambda group: _pass(order, group.sort_by("date"), {}, keep, out)
    return narrow.groupBy("symbol").applyInArrow(compute, _schema(narrow, keep, out))


def joined_pass(bars: DataFrame, stages: list[list[str]], ranks: DataFrame, across: list[str], keep: list[str], out: list[str]) -> DataFrame:
    """As by_symbol_pass, with the columns across of ranks (one row per bar) brought in by symbol, so that wide rows are never shuffled."""
    order, narrow = [name for stage in stages for name in stage], bars.select(*BASE)

    def compute(group: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("date")
        return _pass(order, group.sort_by("date"), {n: _numbers(known, n) for n in across}, keep, out)

    return narrow.groupBy("symbol").cogroup(ranks.groupBy("symbol")).applyInArrow(compute, _schema(narrow, keep, out))


def factor_panel(bars: DataFrame, wanted: Iterable[str] | None = None, keep: Iterable[str] = ("date", "symbol"), long_frames: float = LONG_FRAMES) -> DataFrame:
    """keep and the wanted factors (all by default) for every bar. bars: the columns of BASE, one row per symbol and date.

    With both a pass per symbol and factors across symbols, what the latter need is computed first, on its own, ranked in
    narrow rows by date, and joined to the rest within the pass.
    """
    wanted, keep = list(FACTORS if wanted is None else wanted), list(keep)
    date_stages = _stages(wanted, ACROSS)
    sources = list(dict.fromkeys(n for stage in date_stages for name in stage for n in ACROSS[name][0] if n in NODES))
    own = [n for n in wanted if n in NODES]
    needed = list(dict.fromkeys([*own, *sources]))
    stages = _stages(needed, NODES)
    ops = Columns()
    columns = [[NODES[n][1](ops).alias(n) for n in stage] for stage in stages]
    key = ["date", "symbol"]

    def ranked(df: DataFrame) -> DataFrame:
        for stage in date_stages:
            df = df.select("*", *[ACROSS[n][1]().alias(n) for n in stage])
        return df

    if ops.rows <= long_frames:
        df = bars.select(*BASE)
        for stage in columns:
            df = df.select("*", *stage)
        return ranked(df).select(*keep, *wanted)
    if own and sources:
        names = [n for n in wanted if n in ACROSS]
        ranks = ranked(by_symbol_pass(bars, _stages(sources, NODES), key, sources)).select(*key, *names)
        return joined_pass(bars, stages, ranks, names, list(dict.fromkeys([*key, *keep])), wanted).select(*keep, *wanted)
    return ranked(by_symbol_pass(bars, stages, list(dict.fromkeys([*key, *keep])), needed)).select(*keep, *wanted)


def symbol_summaries(bars: DataFrame, wanted: Iterable[str], summary: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What summary makes of each symbol's bars, in order of date, and the matrix of their wanted factors (bars x factors, NaN for null).

    The factors of a symbol never leave its pass, so that only what summary returns is written or shuffled.
    """
    wanted = list(wanted)
    date_stages = _stages(wanted, ACROSS)
    sources = list(dict.fromkeys(n for stage in date_stages for name in stage for n in ACROSS[name][0] if n in NODES))
    order = [name for stage in _stages([n for n in wanted if n in NODES], NODES) for name in stage]
    names, key, narrow = [n for n in wanted if n in ACROSS], ["date", "symbol"], bars.select(*BASE)

    def whole(table: pa.Table, more: dict[str, np.ndarray]) -> pa.Table:
        values = _values(order, table) | more
        return summary(table, np.column_stack([values[n] for n in wanted]))

    if not names:
        return narrow.groupBy("symbol").applyInArrow(lambda group: whole(group.sort_by("date"), {}), schema)
    ranks = by_symbol_pass(bars, _stages(sources, NODES), key, sources)
    for stage in date_stages:
        ranks = ranks.select("*", *[ACROSS[n][1]().alias(n) for n in stage])

    def joined(group: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("date")
        return whole(group.sort_by("date"), {n: _numbers(known, n) for n in names})

    return narrow.groupBy("symbol").cogroup(ranks.select(*key, *names).groupBy("symbol")).applyInArrow(joined, schema)
