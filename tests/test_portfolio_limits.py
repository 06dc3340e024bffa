import datetime as dt

import numpy as np
import pytest

from barloom.operators import risk as R


def day(k):
    return dt.date(2023, 1, k)


def test_limits_against_a_loop(spark):
    rnd = np.random.default_rng(4)
    symbols = ["a", "b", "c", "d"]
    bars = [(s, dt.date(2022, 12, 1) + dt.timedelta(days=k), float(20 + rnd.normal())) for s in symbols for k in range(60) if not (s == "c" and k == 33)]
    targets = [(day(k), s, w) for k in (3, 10, 17) for s, w in zip(symbols, (0.5, 0.3, 0.2, None))]
    groups, curve = [("a", "g"), ("b", "g")], [(day(1), 0.0), (day(9), -0.3)]
    limits = R.Limits(blacklist=("c",), single=0.4, group=0.5, volatility=0.1, lookback=12, drawdown=0.2, drawdown_scale=0.5)
    b, t = spark.createDataFrame(bars, "symbol string, date date, close double"), spark.createDataFrame(targets, "date date, symbol string, weight double")
    g, c = spark.createDataFrame(groups, "symbol string, `group` string"), spark.createDataFrame(curve, "date date, drawdown double")
    rows = R.constrained(t, limits, groups=g, bars=b, curve=c)
    got = {(r.date, r.symbol): r.weight for r in rows.collect()}
    close = {(s, d): x for s, d, x in bars}
    days = sorted({d for _, d, _ in bars})
    for k in (3, 10, 17):
        w = {"a": 0.4 * 0.5 / 0.7, "b": 0.3 * 0.5 / 0.7, "c": 0.0, "d": 0.0}
        past = [d for d in days if d < day(k)][-12:]
        returns = []
        for d in past:
            total = 0.0
            for s in symbols:
                earlier = [x for x in days if x < d and (s, x) in close]
                if (s, d) in close and earlier:
                    total += w[s] * (close[s, d] / close[s, earlier[-1]] - 1)
            returns.append(total)
        vol = np.std(returns) * np.sqrt(252)
        scale = min(1.0, 0.1 / vol) * (0.5 if k >= 9 else 1.0)
        for s in symbols:
            assert got[day(k), s] == pytest.approx(w[s] * scale)
    summary = {r.date: r for r in R.constraint_summary(rows, limits).collect()}
    assert summary[day(3)].applied == "blacklist;max_single_weight;max_theme_weight;volatility_target"
    assert "drawdown_circuit_breaker" in summary[day(10)].applied and summary[day(10)].drawdown == -0.3
    assert R.constrained(t.limit(0), limits, groups=g, bars=b, curve=c).count() == 0
    free = R.constrained(t, R.Limits()).collect()
    assert all(r.weight == (r.original or 0.0) for r in free)


def test_guard_follows_the_recursion(spark):
    rnd = np.random.default_rng(9)
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=7 * k) for k in range(30)]
    wanted = {(d, s): float(rnd.choice([0.0, 0.2])) for d in days for s in "abc"}
    factors = {(d, s): (int(rnd.integers(0, 2)), int(rnd.integers(0, 2)), float(rnd.normal() / 2), float(rnd.random())) for d in days for s in "abc" if rnd.random() < 0.6}
    t = spark.createDataFrame([(d, s, w) for (d, s), w in wanted.items()], "date date, symbol string, weight double")
    f = spark.createDataFrame([(d, s, *x, None) for (d, s), x in factors.items()], "date date, symbol string, event_risk_count int, negative_event_count int, event_impact_score double, event_confidence_mean double, event_weighted_impact_score double")
    risk = R.EventRisk(least_impact=-0.4, least_confidence=0.3, max_age=10)
    got = {(r.date, r.symbol): (r.action, r.weight) for r in R.event_guard(t, f, risk).collect()}
    want, before = {}, {s: 0.0 for s in "abc"}
    for d in days:
        now = dict.fromkeys("abc", 0.0)
        for s in "abc":
            w = wanted[d, s]
            if w <= 0:
                continue
            near = [x for x in days if x <= d and (d - x).days <= 10 and (x, s) in factors]
            action = "none"
            if near:
                count, negative, impact, sure = factors[near[-1], s]
                severe = impact <= -0.4 or (negative > 0 and impact < 0)
                if sure >= 0.3 and (severe or count > 0):
                    action = "block_new_buy" if severe and before[s] <= 0 else "reduce_weight"
            now[s] = {"none": w, "reduce_weight": w / 2, "block_new_buy": 0.0}[action]
            want[d, s] = (action, now[s])
        before = now
    assert got == want and {a for a, _ in got.values()} == {"none", "reduce_weight", "block_new_buy"}
    with pytest.raises(ValueError):
        R.event_guard(t, f, R.EventRisk(scale=0.0))


def test_costs_and_years(spark):
    trades = spark.createDataFrame([("BUY", 1000.0, 0.3, 0.0), ("sell", 2000.0, 0.6, 2.0), (None, None, None, None)], "side string, gross_value double, fee double, tax double")
    got = {r.scope: r for r in R.cost_summary(trades, 0.0005).collect()}
    assert (got["buy"].avg_cost_bps, got["sell"].avg_cost_bps) == (pytest.approx(8.0), pytest.approx(18.0)) and got["all"].trade_count == 3
    assert {r.trade_count for r in R.cost_summary(trades.limit(0), 0.0005).collect()} == {0}
    curve = R.drawdowns(spark.createDataFrame([(dt.date(2022, 12, 30), 1.0), (day(2), 1.2), (day(3), 0.9)], "date date, equity double"))
    years = {r.year: r for r in R.annual_metrics(curve).collect()}
    assert years[2023].stability_status == "drawdown_watch" and years[2023].year_return == pytest.approx(-0.25) and years[2022].trading_days == 1
