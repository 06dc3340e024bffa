"""Path-dependent steps over scenarios: capped turnover and simulated execution, one grouped task per scenario."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped_targets(targets: DataFrame, caps: dict[str, float]) -> DataFrame:
    """(scenario, date, symbol, weight): each rebalance moves at most the scenario's cap, summed over symbols, from the last weights.

    targets: date, symbol, weight; a symbol without a row has weight 0. A scenario holds one row per rebalance and symbol held.
    """
    scenario = F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(float(cap)).alias("cap")) for name, cap in caps.items()])).alias("s")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        cap, held, out = float(group.cap.iloc[0]), pd.Series(dtype=float), []
        for date, wanted in group.sort_values("date").groupby("date"):
            target = wanted.set_index("symbol").weight
            symbols = held.index.union(target.index)
            was = held.reindex(symbols, fill_value=0.0)
            step = target.reindex(symbols, fill_value=0.0) - was
            moved = float(step.abs().sum())
            held = was + step * (cap / moved if 0 < cap < moved else 1.0)
            held = held[held.abs() > 1e-12]
            out.append(pd.DataFrame({"scenario": group.scenario.iloc[0], "date": date, "symbol": held.index, "weight": held.to_numpy()}))
        return pd.concat(out)

    rows = targets.select("date", "symbol", "weight", scenario).select("date", "symbol", "weight", "s.scenario", "s.cap")
    return rows.groupBy("scenario").applyInPandas(walk, "scenario string, date date, symbol string, weight double")


@dataclass(frozen=True)
class Costs:
    cash: float = 1_000_000.0
    fee: float = 0.0003
    tax: float = 0.001
    slippage: float = 0.0005
    lot: int = 100
    least_trade: float = 0.0


def simulate(targets: DataFrame, bars: DataFrame, costs: Costs) -> DataFrame:
    """(scenario, kind, date, symbol, shares, value, cash, fee, tax, realised): one schema for four kinds of rows per scenario.

    'trade': shares and gross value, negative for sales, with fee, tax and, of sales, the profit over the cost of the lots
    sold, first in first out. 'equity': every day's cash and value of the holdings. 'holding': every day's shares and value
    of each symbol held. 'rebalance': value is the turnover, traded value as a share of equity at the open.

    Targets (scenario, date, symbol, weight) are executed at the open of the first date after theirs, in whole lots,
    sales before purchases; shares bought on a day are not sold on it; purchases stop at the cash left. Days are marked
    at the last known close. Only bars of symbols ever held reach a scenario's task.
    """
    # The first bar date after each target date: one row per date, so one task may order them.
    days = bars.select("date", F.col("date").alias("bar")).distinct().unionByName(targets.select("date").distinct().withColumn("bar", F.lit(None).cast("date")))
    later = Window.orderBy((-F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("k")).rangeBetween(Window.unboundedPreceding, -1)
    steps = days.withColumn("next", F.min("bar").over(later)).where("bar IS NULL AND next IS NOT NULL").select("date", "next")
    orders = targets.join(F.broadcast(steps), "date").select("scenario", F.col("next").alias("date"), "symbol", "weight")
    held = targets.select("scenario", "symbol").distinct()
    prices = held.join(bars.select("date", "symbol", "open", "close"), "symbol")
    feed = prices.join(orders, ["scenario", "date", "symbol"], "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        open_ = group.pivot(index="date", columns="symbol", values="open")
        close = group.pivot(index="date", columns="symbol", values="close").ffill()
        weight = group.pivot(index="date", columns="symbol", values="weight")
        symbols, cash = list(close.columns), costs.cash
        shares, locked = np.zeros(len(symbols), dtype=np.int64), np.zeros(len(symbols), dtype=np.int64)
        lots = lambda x: (np.floor(np.nan_to_num(x) / costs.lot) * costs.lot).astype(np.int64)
        lots_held: list[deque] = [deque() for _ in symbols]
        out = []
        for day in close.index:
            locked[:] = 0
            price, wanted = open_.loc[day].to_numpy(), weight.loc[day].to_numpy()
            if not np.isnan(wanted).all():
                tradable = np.isfinite(price) & (price > 0)
                traded, equity = 0.0, cash + float(np.nansum(shares * np.where(tradable, price, close.loc[day].to_numpy())))
                goal = np.where(tradable, lots(equity * np.nan_to_num(wanted) / np.where(tradable, price, 1.0)), shares)
                for i in np.flatnonzero(goal < shares):
                    n = int(lots(np.array(min(shares[i] - goal[i], shares[i] - locked[i]))))
                    if n <= 0:
                        continue
                    gross = price[i] * (1 - costs.slippage) * n
                    fee, tax, paid, left = gross * costs.fee, gross * costs.tax, 0.0, n
                    while left:
                        lot = lots_held[i][0]
                        used = min(left, lot[0])
                        paid += used * lot[1]
                        lot[0] -= used
                        left -= used
                        if not lot[0]:
                            lots_held[i].popleft()
                    shares[i] -= n
                    cash += gross - fee - tax
                    traded += gross
                    out.append(("trade", day, symbols[i], -n, -gross, cash, fee, tax, gross - fee - tax - paid))
                for i in np.flatnonzero(goal > shares):
                    fill = price[i] * (1 + costs.slippage)
                    n = int(min(goal[i] - shares[i], lots(np.array(cash / (fill * (1 + costs.fee))))))
                    n -= n % costs.lot
                    gross = fill * n
                    if n <= 0 or gross < costs.least_trade:
                        continue
                    fee = gross * costs.fee
                    shares[i] += n
                    locked[i] += n
                    lots_held[i].append([n, fill])
                    cash -= gross + fee
                    traded += gross
                    out.append(("trade", day, symbols[i], n, gross, cash, fee, 0.0, 0.0))
                out.append(("rebalance", day, None, int(shares.sum()), traded / equity if equity > 0 else 0.0, cash, 0.0, 0.0, 0.0))
            marks = shares * close.loc[day].to_numpy()
            out += [("holding", day, symbols[i], int(shares[i]), float(marks[i]), cash, 0.0, 0.0, 0.0) for i in np.flatnonzero(shares)]
            out.append(("equity", day, None, int(shares.sum()), float(np.nansum(marks)), cash, 0.0, 0.0, 0.0))
        frame = pd.DataFrame(out, columns=["kind", "date", "symbol", "shares", "value", "cash", "fee", "tax", "realised"])
        return frame.assign(scenario=group.scenario.iloc[0])

    return feed.groupBy("scenario").applyInPandas(run, "scenario string, kind string, date date, symbol string, shares long, value double, cash double, fee double, tax double, realised double")


def equity_metrics(ledger: DataFrame, start: float = 1_000_000.0, year_days: int = 252) -> DataFrame:
    """Per scenario: returns, volatility, Sharpe and Calmar ratio, worst drawdown, share of sales with profit, turnover, trades and costs."""
    order = Window.partitionBy("scenario").orderBy("date")
    equity = ledger.where("kind = 'equity'").select("scenario", "date", (F.col("cash") + F.col("value")).alias("e"))
    step = F.coalesce(F.try_divide("e", F.lag("e").over(order)) - 1, F.lit(0.0))
    daily = equity.withColumn("r", step).withColumn("dd", F.col("e") / F.max("e").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    per = daily.groupBy("scenario").agg(F.max_by("e", "date").alias("final_equity"), F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.min("dd").alias("max_drawdown"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    sold = (F.col("kind") == "trade") & (F.col("shares") < 0)
    rest = ledger.groupBy("scenario").agg(
        F.count_if(F.col("kind") == "trade").alias("trade_count"), F.count_if(F.col("kind") == "rebalance").alias("rebalance_count"),
        F.coalesce(F.avg(F.when(sold, (F.col("realised") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(of("rebalance", F.col("value"))), F.lit(0.0)).alias("avg_turnover"), F.coalesce(F.sum(of("rebalance", F.col("value"))), F.lit(0.0)).alias("total_turnover"),
        F.coalesce(F.sum(of("trade", F.col("fee") + F.col("tax"))), F.lit(0.0)).alias("cost"), F.sum(of("trade", F.abs("value"))).alias("traded"),
    )
    total = F.col("final_equity") / start - 1
    annual = F.pow(1 + total, float(year_days) / F.col("n")) - 1
    root = F.sqrt(F.lit(float(year_days)))
    return per.join(rest, "scenario").select(
        "scenario", F.lit(start).alias("initial_cash"), "final_equity", total.alias("total_return"), annual.alias("annual_return"), (F.col("s") * root).alias("annual_volatility"), F.coalesce(F.try_divide("m", "s") * root, F.lit(0.0)).alias("sharpe"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"), "win_rate", "avg_turnover", "total_turnover", "trade_count", "rebalance_count", "cost", F.try_divide(F.col("cost") * 10_000, "traded").alias("cost_bps"),
    )
