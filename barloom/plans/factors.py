"""Queries on the factor panel over derived bars, and the SQL that states their results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.factors import FACTORS, factor_panel
from barloom.operators.wide import bucket_count, over_buckets
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, bars

#: Added before rounding: means of rounded inputs often lie exactly between two results, where engines differ.
OFF_TIES = 4.3e-9


def need(w: int) -> int:
    """Observations a frame needs, stated here apart from the operators."""
    return {5: 4, 6: 4, 10: 8, 14: 10, 20: 13, 24: 16, 40: 26, 60: 40, 120: 80, 240: 160}[w]


def over(w: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, w: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {over(w)} >= {need(w) if least is None else least} THEN {agg}({x}) {over(w)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def corr(a: str, b: str, w: int) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({x}) {over(w)} >= {need(w)} THEN (covar_samp({x}, {y}) {over(w)}) / nullif((stddev_samp({x}) {over(w)}) * (stddev_samp({y}) {over(w)}), 0) END"


#: name -> (stages of helper columns, {factor: SQL}, decimals). Each stage may use the columns of the stages before it.
FAMILIES: dict[str, tuple[list[dict[str, str]], dict[str, str], int]] = {}
R = {"r": f"close / {lag('close')} - 1", "pc": lag("close")}


def family(name: str, stages: list[dict[str, str]], columns: dict[str, str], digits: int = 6) -> None:
    FAMILIES[name] = (stages, columns, digits)


family("f_momentum", [], {f"momentum_{w}": f"close / {lag('close', w)} - 1" for w in (1, 2, 3, 5, 10, 20, 40, 60, 120, 240)})
family("f_reversal", [], {f"reversal_{w}": f"1 - close / {lag('close', w)}" for w in (1, 2, 3, 5, 10, 20)})
family("f_volatility", [R], {f"volatility_{w}": roll("stddev_samp", "r", w) for w in (5, 10, 20, 40, 60, 120, 240)})
family(
    "f_semivol",
    [R, {"dn": "CASE WHEN r < 0 THEN r ELSE 0 END", "up": "CASE WHEN r > 0 THEN r ELSE 0 END"}],
    {**{f"downside_volatility_{w}": roll("stddev_samp", "dn", w) for w in (5, 10, 20, 60, 120)}, **{f"upside_volatility_{w}": roll("stddev_samp", "up", w) for w in (5, 10, 20, 60)}},
)
family(
    "f_max_drawdown",
    [{f"l{w}": f"list(close) {over(w)}" for w in (20, 60, 120)}],
    {f"max_drawdown_{w}": f"CASE WHEN len(l{w}) >= {need(w)} THEN list_min(list_transform(l{w}, lambda x, i: x / list_max(l{w}[1:i]) - 1)) END" for w in (20, 60, 120)},
)
MA = {f"ma{w}": roll("avg", "close", w) for w in (5, 10, 20, 40, 60, 120, 240)}
family("f_ma", [MA], {**{f"ma_bias_{w}": f"close / ma{w} - 1" for w in (5, 10, 20, 40, 60, 120, 240)}, **{f"ma_slope_{w}": f"ma{w} / {lag(f'ma{w}', w)} - 1" for w in (5, 10, 20, 60)}})


def ema(w: int, least: int) -> str:
    a = 2 / (w + 1)
    return f"CASE WHEN len(closes) >= {least} THEN list_reduce(closes, lambda e, x: {1 - a!r} * e + {a!r} * x) END"


EMA_NEED = {5: 4, 10: 8, 12: 10, 20: 13, 26: 17, 60: 40, 120: 80}
CLOSES = {"closes": "list(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"}
EMA = {f"e{w}": ema(w, n) for w, n in EMA_NEED.items()}
family("f_ema", [CLOSES, EMA], {**{f"ema_bias_{w}": f"close / e{w} - 1" for w in (5, 10, 12, 20, 26, 60, 120)}, **{f"ema_slope_{w}": f"e{w} / {lag(f'e{w}', w)} - 1" for w in (12, 26, 60)}})
family(
    "f_macd",
    [CLOSES, {k: EMA[k] for k in ("e12", "e26")}, {"m": "e12 - e26"}, {"ms": "list(m) FILTER (WHERE m IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"}, {"sig": "CASE WHEN len(ms) >= 6 THEN list_reduce(ms, lambda e, x: 0.8 * e + 0.2 * x) END"}],
    {"macd_diff": "m / close", "macd_signal": "sig / close", "macd_hist": "(m - sig) / close"},
)
# The smoothing's weights reach over gaps; these bars have none after the first known value.
STOCHASTIC = {"st": f"100 * (close - ({roll('min', 'low', 20)})) / nullif(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}), 0)"}


def thirds(x: str) -> str:
    return f"CASE WHEN len({x}) >= 6 THEN list_reduce({x}, lambda e, v: 2 / 3 * e + 1 / 3 * v) END"


def history(x: str) -> str:
    return f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


family("f_kdj", [STOCHASTIC, {"sl": history("st")}, {"k": thirds("sl")}, {"kl": history("k")}, {"d": thirds("kl")}], {"kdj_k_9": "k", "kdj_d_9": "d", "kdj_j_9": "3 * k - 2 * d"})
family("f_rsi", [R, {"g": "greatest(r, 0)", "l": "greatest(-r, 0)", "known": "r IS NOT NULL"}, {"g": "CASE WHEN known THEN g END", "l": "CASE WHEN known THEN l END"}], {f"rsi_{w}": f"100 - 100 / (1 + ({roll('avg', 'g', w)}) / nullif({roll('avg', 'l', w)}, 0))" for w in (6, 14, 24)}, 5)
TP = {"tp": "(high + low + close) / 3"}
family(
    "f_cci_williams",
    [TP, {f"dev{w}": f"tp - ({roll('avg', 'tp', w)})" for w in (14, 20)}, {f"a{w}": f"abs(dev{w})" for w in (14, 20)}],
    {**{f"cci_{w}": f"dev{w} / nullif(0.015 * ({roll('avg', f'a{w}', w)}), 0)" for w in (14, 20)}, **{f"williams_r_{w}": f"-100 * (({roll('max', 'high', w)}) - close) / nullif(({roll('max', 'high', w)}) - ({roll('min', 'low', w)}), 0)" for w in (14, 20)}},
    4,
)
family(
    "f_mfi",
    [TP, {"step": f"tp - {lag('tp')}"}, {"fin": "CASE WHEN step > 0 THEN tp * volume ELSE 0 END", "fout": "CASE WHEN step < 0 THEN tp * volume ELSE 0 END"}],
    {f"money_flow_index_{w}": f"100 - 100 / (1 + ({roll('sum', 'fin', w)}) / nullif({roll('sum', 'fout', w)}, 0))" for w in (14, 20)},
    5,
)
HL = {**{f"hh{w}": roll("max", "high", w) for w in (20, 40, 60, 120, 240)}, **{f"ll{w}": roll("min", "low", w) for w in (20, 40, 60, 120, 240)}}
family(
    "f_price_position",
    [HL],
    {
        **{f"price_position_{w}": f"(close - ll{w}) / nullif(hh{w} - ll{w}, 0)" for w in (20, 40, 60, 120, 240)},
        **{f"breakout_high_{w}": f"close / hh{w} - 1" for w in (20, 40, 60, 120, 240)},
        **{f"breakdown_low_{w}": f"close / ll{w} - 1" for w in (20, 40, 60, 120, 240)},
        **{f"close_to_high_{w}": f"close / hh{w} - 1" for w in (20, 60, 120)},
        **{f"close_to_low_{w}": f"close / ll{w} - 1" for w in (20, 60, 120)},
        "new_high_distance_60": "close / hh60 - 1",
        "new_low_distance_60": "close / ll60 - 1",
    },
)
family(
    "f_amount_stats",
    [],
    {
        **{f"{x}_mean_{w}": roll("avg", x, w) for x in ("amount", "turnover") for w in (5, 10, 20, 40, 60, 120)},
        **{f"{x}_zscore_{w}": f"({x} - ({roll('avg', x, w)})) / nullif({roll('stddev_samp', x, w)}, 0)" for x in ("amount", "turnover") for w in (20, 60)},
    },
    4,
)
family(
    "f_percentile_in_window",
    [{f"{x[0]}{w}": f"list({x}) {over(w)}" for x in ("amount", "turnover") for w in (20, 60)}],
    {f"{x}_percentile_{w}": f"CASE WHEN len({x[0]}{w}) >= {need(w)} THEN (len(list_filter({x[0]}{w}, lambda v: v < {x})) + (len(list_filter({x[0]}{w}, lambda v: v = {x})) + 1) / 2.0) / len({x[0]}{w}) END" for x in ("amount", "turnover") for w in (20, 60)},
)
family(
    "f_ratios",
    [],
    {
        **{f"{x}_ratio_5_20": f"({roll('avg', x, 5, 5)}) / ({roll('avg', x, 20, 15)}) - 1" for x in ("volume", "amount")},
        **{f"{x}_ratio_10_60": f"({roll('avg', x, 10, 8)}) / ({roll('avg', x, 60, 40)}) - 1" for x in ("volume", "amount")},
    },
)
RUN = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
family(
    "f_vwap_obv_pvt",
    [R, {"obv": f"sum(sign(coalesce(r, 0)) * volume) {RUN}", "pvt": f"round(sum(coalesce(r, 0) * volume) {RUN}, 6)"}],
    {
        **{f"vwap_bias_{w}": f"close / (({roll('sum', 'amount', w)}) / nullif({roll('sum', 'volume', w)}, 0)) - 1" for w in (5, 20, 60)},
        **{f"obv_slope_{w}": f"obv / nullif({lag('obv', w)}, 0) - 1" for w in (20, 60)},
        **{f"price_volume_trend_{w}": f"pvt / nullif({lag('pvt', w)}, 0) - 1" for w in (20, 60)},
    },
    4,
)
family(
    "f_rolling_corr",
    [{**R, "da": f"amount / nullif({lag('amount')}, 0) - 1"}],
    {**{f"volume_price_corr_{w}": corr("volume", "close", w) for w in (20, 60)}, **{f"return_amount_corr_{w}": corr("r", "da", w) for w in (20, 60)}},
    5,
)
Z = {f"z{w}": f"(amount - ({roll('avg', 'amount', w)})) / nullif({roll('stddev_samp', 'amount', w)}, 0)" for w in (20, 60)}
family(
    "f_shock_flow",
    [{**R, **Z}, {**{f"s{w}": flag(f"z{w} > 1.5") for w in (20, 60)}, "sf": "sign(coalesce(r, 0)) * amount"}],
    {**{f"amount_shock_count_{w}": roll("sum", f"s{w}", w) for w in (20, 60)}, **{f"signed_volume_flow_{w}": f"({roll('sum', 'sf', w)}) / nullif({roll('sum', 'amount', w)}, 0)" for w in (20, 60)}},
)
CANDLE = {"us": "(high - greatest(open, close)) / nullif(high - low, 0)", "ls": "(least(open, close) - low) / nullif(high - low, 0)", "gap": f"open / {lag('close')} - 1"}
family(
    "f_candle",
    [{**R, **CANDLE}],
    {"intraday_return": "close / open - 1", "overnight_return": "gap", "gap_return": "gap", "amplitude": "(high - low) / pc", "close_position": "(close - low) / nullif(high - low, 0)", "upper_shadow": "us", "lower_shadow": "ls", "body_size": "abs(close - open) / nullif(high - low, 0)"},
)
TR = {"tr": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END", "amp": "(high - low) / pc"}
AMP = {f"am{w}": roll("avg", "amp", w) for w in (5, 10, 20, 60)}
family(
    "f_atr_amplitude",
    [R, TR, {**AMP, **{f"atr{w}": f"({roll('avg', 'tr', w)}) / close" for w in (5, 10, 20, 60)}}],
    {
        **{f"atr_pct_{w}": f"atr{w}" for w in (5, 10, 20, 60)},
        **{f"amplitude_mean_{w}": f"am{w}" for w in (5, 10, 20, 60)},
        **{f"amplitude_zscore_{w}": f"(amp - am{w}) / nullif({roll('stddev_samp', 'amp', w)}, 0)" for w in (20, 60)},
        "atr_contraction_20_60": "atr20 / nullif(atr60, 0)",
        **{f"range_compression_{w}": f"am{w} / nullif(am60, 0)" for w in (20, 60)},
    },
)
BB = {f"bz{w}": f"(close - ({roll('avg', 'close', w)})) / nullif({roll('stddev_samp', 'close', w)}, 0)" for w in (20, 60)}
family(
    "f_bollinger",
    [BB, {f"b{w}": flag(f"bz{w} > 2") for w in (20, 60)}],
    {
        **{f"bollinger_zscore_{w}": f"bz{w}" for w in (20, 60)},
        **{f"bollinger_width_{w}": f"4 * ({roll('stddev_samp', 'close', w)}) / ({roll('avg', 'close', w)})" for w in (20, 60)},
        **{f"bollinger_breakout_count_{w}": roll("sum", f"b{w}", w) for w in (20, 60)},
    },
)
family("f_skew_kurt", [R], {**{f"return_skew_{w}": roll("skewness", "r", w, n) for w, n in ((20, 15), (60, 40))}, **{f"return_kurt_{w}": roll("kurtosis", "r", w, n) for w, n in ((20, 15), (60, 40))}}, 5)
family("f_amihud", [R, {"il": "1e9 * abs(r) / nullif(amount, 0)"}], {f"amihud_illiquidity_{w}": f"({roll('avg', 'il', w, n)}) / 1e9" for w, n in ((20, 15), (60, 40))}, 14)
family(
    "f_limit_gap_counts",
    [
        {**R, **CANDLE},
        {
            "lu": flag("r >= 0.095"), "ld": flag("r <= -0.095"), "nu": flag("r >= 0.075"), "nd": flag("r <= -0.075"), "gu": flag("gap > 0.02"), "gd": flag("gap < -0.02"),
            "lus": flag("us > 0.55"), "lls": flag("ls > 0.55"), "ud": flag("r > 0"), "dd": flag("r < 0"), "pb": flag("close > open"),
        },
    ],
    {
        **{f"limit_{s}_count_{w}": roll("sum", x, w, 1) for s, x in (("up", "lu"), ("down", "ld")) for w in (20, 60)},
        "limit_up_near_5": roll("sum", "nu", 5, 1),
        "limit_down_near_5": roll("sum", "nd", 5, 1),
        **{f"gap_{s}_count_{w}": roll("sum", x, w) for s, x in (("up", "gu"), ("down", "gd")) for w in (20, 60)},
        **{f"long_{s}_shadow_count_{w}": roll("sum", x, w) for s, x in (("upper", "lus"), ("lower", "lls")) for w in (20, 60)},
        **{f"{s}_day_ratio_{w}": roll("avg", x, w, n) for s, x in (("up", "ud"), ("down", "dd")) for w, n in ((20, 15), (60, 40))},
        **{f"positive_body_ratio_{w}": roll("avg", "pb", w) for w in (20, 60)},
    },
)
family(
    "f_tail_quantiles",
    [R, {"ar": "abs(r)"}],
    {
        **{f"{s}_tail_return_{w}": f"CASE WHEN count(r) {over(w)} >= {need(w)} THEN quantile_cont(r, {q}) {over(w)} END" for s, q in (("downside", 0.1), ("upside", 0.9)) for w in (20, 60)},
        **{f"return_abs_mean_{w}": roll("avg", "ar", w) for w in (20, 60)},
    },
)
family(
    "f_autocorr",
    [R, {f"l{w}": f"list(r) FILTER (WHERE r IS NOT NULL) {over(w)}" for w in (20, 60)}],
    {
        f"return_autocorr_{w}": f"CASE WHEN len(l{w}) >= {need(w)} AND list_max(l{w}) > list_min(l{w}) THEN (SELECT covar_pop(p.a, p.b) / nullif(stddev_pop(p.a) * stddev_pop(p.b), 0) FROM (SELECT unnest(l{w}[1:len(l{w}) - 1]) AS a, unnest(l{w}[2:]) AS b) p) END"
        for w in (20, 60)
    },
    5,
)
VOLS = {f"v{w}": roll("stddev_samp", "r", w) for w in (20, 60, 120)}
LISTS = {f"{x[0]}{w}": f"list({x}) {over(w)}" for x in ("amount", "turnover") for w in (20, 60)}
PCT = {f"{x[0]}p{w}": FAMILIES["f_percentile_in_window"][1][f"{x}_percentile_{w}"] for x in ("amount", "turnover") for w in (20, 60)}
CV = {f"{x}_cv_{w}": f"({roll('stddev_samp', x, w)}) / nullif({roll('avg', x, w)}, 0)" for x in ("volume", "amount", "turnover") for w in (20, 60)}
family("f_cv_crowding", [R, {**LISTS, **{k: VOLS[k] for k in ("v20", "v60")}}, PCT], {**CV, **{f"{x}_crowding_{w}": f"{x[0]}p{w} * v{w}" for x in ("amount", "turnover") for w in (20, 60)}})
family(
    "f_efficiency_trend",
    [R, {**VOLS, "ar": "abs(r)", **{f"m{w}": f"abs(close / {lag('close', w)} - 1)" for w in (20, 60, 120)}}],
    {
        **{f"price_efficiency_{w}": f"m{w} / nullif({roll('sum', 'ar', w)}, 0)" for w in (20, 60, 120)},
        **{f"trend_strength_{w}": f"m{w} / nullif(v{w}, 0)" for w in (20, 60, 120)},
        **{f"volatility_contraction_{w}": f"v{w} / nullif(v120, 0)" for w in (20, 60)},
    },
)
family(
    "f_alignment",
    [{**MA, **CLOSES}, {k: EMA[k] for k in ("e5", "e10", "e20", "e60")}],
    {f"{n}_alignment_score": "(" + " + ".join(flag(f"{p}{a} > {p}{b}") for a, b in ((5, 10), (10, 20), (20, 60))) + ") / 3" for n, p in (("ma", "ma"), ("ema", "e"))},
)
family(
    "f_setups",
    [{**R, **Z, **HL, **CV, **MA}, {**{f"md{w}": f"CASE WHEN count(volume_cv_{w}) {over(w)} >= {need(w)} THEN quantile_cont(volume_cv_{w}, 0.5) {over(w)} END" for w in (20, 60)}, **{f"st{w}": flag(f"r > 0 AND r < 0.01 AND z{w} > 1") for w in (20, 60)}, **{f"pu{w}": flag(f"r < 0 AND z{w} < -0.5") for w in (20, 60)}, **{f"am{w}": flag(f"close > ma{w}") for w in (20, 60)}}],
    {
        **{f"shrinkage_breakout_{w}": f"({flag(f'close / hh{w} - 1 > -0.01')}) * ({flag(f'volume_cv_{w} < md{w} - 1e-12')})" for w in (20, 60)},
        **{f"stalled_up_volume_{w}": roll("sum", f"st{w}", w) for w in (20, 60)},
        **{f"low_volume_pullback_{w}": roll("sum", f"pu{w}", w) for w in (20, 60)},
        **{f"close_above_ma_ratio_{w}": roll("avg", f"am{w}", w) for w in (20, 60)},
    },
)
_STREAK = "sum({f}) OVER (PARTITION BY symbol, {g} ORDER BY date ROWS UNBOUNDED PRECEDING)"
family(
    "f_streaks",
    [R, {"uf": flag("r > 0"), "df": flag("r < 0")}, {"ug": f"sum(1 - uf) {RUN}", "dg": f"sum(1 - df) {RUN}"}],
    {"up_streak": _STREAK.format(f="uf", g="ug"), "down_streak": _STREAK.format(f="df", g="dg")},
)


def _share(x: str, digits: int = 9) -> str:
    x = f"round({x}, {digits})"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


CS = {f"mom{w}": f"close / {lag('close', w)} - 1" for w in (20, 60, 120)} | {"rev5": f"1 - close / {lag('close', 5)}"} | {f"am{w}": roll("avg", "amount", w) for w in (20, 60)} | {f"to{w}": roll("avg", "turnover", w) for w in (20, 60)}
CS_RANKS = {
    **{f"cs_momentum_rank_{w}": _share(f"mom{w}") for w in (20, 60, 120)},
    "cs_reversal_rank_5": _share("rev5"),
    **{f"cs_volatility_rank_{w}": _share(f"v{w}") for w in (20, 60)},
    **{f"cs_amount_rank_{w}": _share(f"am{w}", 5) for w in (20, 60)},
    **{f"cs_turnover_rank_{w}": _share(f"to{w}") for w in (20, 60)},
}
# Values are compared after rounding, so that ties do not hang on the last bit.
family("f_cross_sectional", [R, {**CS, "v20": VOLS["v20"], "v60": VOLS["v60"]}], CS_RANKS)
family(
    "f_liquidity_risk",
    [R, {**CS, "v20": VOLS["v20"]}, {"p1": _share("v20"), "p2": _share("to20"), "p3": _share("am20", 5)}],
    {"cs_liquidity_risk_score": "list_avg(list_filter([p1, p2, p3], lambda x: x IS NOT NULL))"},
)
family("f_market_breadth", [R], {"market_breadth": f"avg({flag('r > 0')}) OVER (PARTITION BY date)", "market_mean_return": "avg(r) OVER (PARTITION BY date)"})


def _query(name: str):
    _, columns, digits = FAMILIES[name]

    def query(spark: SparkSession, root: str) -> DataFrame:
        panel = factor_panel(bars(spark, root), list(columns))
        return panel.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "symbol", *[(F.round(F.col(n) + (OFF_TIES if digits < 7 else 0), digits) + 0.0).alias(n) for n in columns])

    query.__name__, query.__doc__ = name, f"Factors: {', '.join(columns)}."
    return query


def _sql(name: str) -> str:
    stages, columns, digits = FAMILIES[name]
    ctes, last = [BARS_SQL], "bars"
    for k, stage in enumerate(stages):
        replaced = [n for n in stage if any(n in s for s in stages[:k])]
        star = f"* EXCLUDE ({', '.join(replaced)})" if replaced else "*"
        ctes.append(f"s{k} AS (SELECT {star}, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {last})")
        last = f"s{k}"
    out = ", ".join(f"round(CAST({x} AS DOUBLE) + {OFF_TIES if digits < 7 else 0}, {digits}) + 0.0 AS {n}" for n, x in columns.items())
    return f"WITH {', '.join(ctes)} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {out} FROM {last}"


#: Decimals by factor, for the panel of all.
DIGITS = {name: digits for _, columns, digits in FAMILIES.values() for name in columns}


def factor_panel_all(spark: SparkSession, root: str) -> DataFrame:
    """All factors of every bar."""
    most = table(spark, root, "lineitem").count()  # a day's shipments make a bar, so there are no more; from the files' footers

    # Rounding by arithmetic: 237 decimal roundings a row would cost more than the factors.
    def rounded(part: pa.Table, values: dict[str, np.ndarray], _: list[int]) -> pa.Table:
        with np.errstate(all="ignore"):
            out = {n: np.floor((values[n] + (OFF_TIES if DIGITS[n] < 7 else 0)) * 10.0 ** DIGITS[n] + 0.5) / 10.0 ** DIGITS[n] for n in FACTORS}
        day = pc.strftime(part["date"].cast(pa.timestamp("s")), format="%Y-%m-%d")
        return pa.table({"date": day.cast(pa.string()), **{n: part[n].cast(kinds[n]) for n in kinds}, **{n: pa.array(v, from_pandas=True) for n, v in out.items()}})

    kinds = {"symbol": pa.string(), "close": pa.float64(), "amount": pa.float64()}
    schema = "date string, symbol string, " + ", ".join(f"{n} double" for n in ["close", "amount", *FACTORS])
    return over_buckets(bars(spark, root, bucket_count(most)), most, FACTORS)(rounded, schema)


def _all_sql() -> str:
    """The families side by side, each stated on its own."""
    parts = [f"({_sql(name)}) AS {name}" for name in FAMILIES]
    joined = " ".join([f"FROM (WITH {BARS_SQL} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, close, amount FROM bars) AS b", *(f"JOIN {p} USING (date, symbol)" for p in parts)])
    return f"SELECT date, symbol, close, amount, {', '.join(f'{family}.{n}' for family, (_, columns, _) in FAMILIES.items() for n in columns)} {joined}"


QUERIES = {**{name: _query(name) for name in FAMILIES}, "factor_panel_all": factor_panel_all}
SQL = {**{name: _sql(name) for name in FAMILIES}, "factor_panel_all": _all_sql()}
