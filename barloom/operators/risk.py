"""Limits on target weights, as aggregates and windows per rebalance date, and what events do to them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import by_symbol
from barloom.operators.events import latest_within
from barloom.operators.trailing import day_number


@dataclass(frozen=True)
class Limits:
    """What a portfolio may hold; a limit of 0 does not apply."""

    blacklist: tuple[str, ...] = ()
    single: float = 0.0
    group: float = 0.0
    volatility: float = 0.0
    lookback: int = 20
    drawdown: float = 0.0
    drawdown_scale: float = 0.5
    year_days: int = 252


def drawdowns(equity: DataFrame) -> DataFrame:
    """(date, equity, daily_return, running_max, drawdown) of a curve of one row per date. A calendar, so one task may order it."""
    order = Window.orderBy("date")
    top = F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0))
    step = F.coalesce(F.try_divide("equity", F.lag("equity").over(order)) - 1, F.lit(0.0))
    return equity.select("date", "equity", step.alias("daily_return"), top.alias("running_max"), (F.try_divide("equity", top) - 1).alias("drawdown"))


def drawdown_at(dates: DataFrame, curve: DataFrame) -> DataFrame:
    """(date, drawdown): each of dates with the curve's last known drawdown on or before it; null where there is none."""
    days = dates.select("date", F.lit(None).cast("double").alias("d"), F.lit(True).alias("asked")).distinct()
    both = days.unionByName(curve.select("date", F.col("drawdown").alias("d"), F.lit(False).alias("asked")).where("d IS NOT NULL"))
    last = F.last("d", ignorenulls=True).over(Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.select("date", last.alias("drawdown"), "asked").where("asked").drop("asked")


def realised_volatility(weights: DataFrame, bars: DataFrame, lookback: int, year_days: int = 252) -> DataFrame:
    """(date, volatility): that of the weights held over the last lookback trading days strictly before each date; null below max(5, min(lookback, 10)) days.

    weights: date, symbol, weight. A day without a bar of a symbol counts as no return of it. Each held symbol meets
    lookback days by an equi-join, so the work is holdings times lookback.
    """
    returns = bars.select("symbol", "date", F.coalesce(F.try_divide("close", F.lag("close").over(by_symbol())) - 1, F.lit(0.0)).alias("r"))
    numbered = bars.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("i"))  # a calendar
    asked = weights.select("date").distinct()
    both = numbered.select("date", "i", F.lit(False).alias("asked")).unionByName(asked.select("date", F.lit(None).cast("int").alias("i"), F.lit(True).alias("asked")))
    before = F.coalesce(F.max("i").over(Window.orderBy(day_number(F.col("date"))).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = both.select("date", before.alias("last"), "asked").where("asked")
    spans = ends.select("date", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last") - (lookback - 1)), F.greatest(F.col("last"), F.lit(0)), F.lit(1))).alias("i")) if lookback > 0 else ends.limit(0)
    spans = spans.join(ends.where("last > 0").select("date"), "date", "left_semi").join(numbered.withColumnRenamed("date", "day"), "i").select("date", "day")
    held = weights.where("weight <> 0").join(spans, "date").join(returns.withColumnRenamed("date", "day"), ["symbol", "day"])
    daily = held.groupBy("date", "day").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    full = spans.join(daily, ["date", "day"], "left").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.coalesce("r", F.lit(0.0))).alias("s"))
    enough = F.col("n") >= max(5, min(lookback, 10))
    return asked.join(full, "date", "left").select("date", F.when(enough, F.col("s") * F.sqrt(F.lit(float(year_days)))).alias("volatility"))


def constrained(targets: DataFrame, limits: Limits, *, groups: DataFrame | None = None, bars: DataFrame | None = None, curve: DataFrame | None = None) -> DataFrame:
    """(date, symbol, group, original, listed, capped, grouped, volatility, drawdown, weight): targets after each limit, in this order.

    blacklist (listed), cap per symbol (capped), cap per group by scaling (grouped; symbols without a group are free),
    then the whole date scaled to the volatility target, then by drawdown_scale where the curve's drawdown is at the limit
    or worse. What is taken away stays cash. groups: one row per symbol with a group. Null weights count as 0. The cap on
    turnover, which needs the date before, is portfolio.capped_targets.
    """
    w = targets.select("date", "symbol", F.coalesce("weight", F.lit(0.0)).alias("original"))
    if groups is not None:
        w = w.join(groups.select("symbol", "group"), "symbol", "left")
    else:
        w = w.withColumn("group", F.lit(None).cast("string"))
    barred = F.col("symbol").isin(list(limits.blacklist)) if limits.blacklist else F.lit(False)
    w = w.withColumn("listed", F.when(barred & (F.col("original") > 0), 0.0).otherwise(F.col("original")))
    w = w.withColumn("capped", F.least("listed", F.lit(limits.single)) if limits.single > 0 else F.col("listed"))
    total = F.sum("capped").over(Window.partitionBy("date", "group"))
    over = F.col("group").isNotNull() & (total > limits.group) & (F.col("capped") > 0)
    w = w.withColumn("grouped", F.when(over, F.col("capped") * limits.group / total).otherwise(F.col("capped")) if limits.group > 0 else F.col("capped"))
    none = F.lit(None).cast("double")
    if bars is not None and limits.lookback > 1:
        w = w.join(realised_volatility(w.select("date", "symbol", F.col("grouped").alias("weight")), bars, limits.lookback, limits.year_days), "date", "left")
    else:
        w = w.withColumn("volatility", none)
    w = w.join(drawdown_at(w, curve), "date", "left") if curve is not None else w.withColumn("drawdown", none)
    calm = F.when((F.col("volatility") > limits.volatility) & F.lit(limits.volatility > 0), F.lit(limits.volatility) / F.col("volatility")).otherwise(1.0)
    broken = F.when((F.col("drawdown") <= -abs(limits.drawdown)) & F.lit(limits.drawdown > 0), F.lit(min(1.0, max(0.0, limits.drawdown_scale)))).otherwise(1.0)
    return w.withColumn("weight", F.greatest(F.lit(0.0), F.col("grouped") * calm * broken)).select("date", "symbol", "group", "original", "listed", "capped", "grouped", "volatility", "drawdown", "weight")


def constraint_summary(rows: DataFrame, limits: Limits) -> DataFrame:
    """Per date of constrained: gross weights before and after, cash, the largest holding and group, and which limits bound."""
    per_group = rows.groupBy("date", "group").agg(
        F.sum("original").alias("before"), F.sum("weight").alias("after"), F.max("weight").alias("top"), F.max("volatility").alias("volatility"), F.max("drawdown").alias("drawdown"),
        F.max((F.col("listed") < F.col("original")).cast("int")).alias("b"), F.max((F.col("capped") < F.col("listed")).cast("int")).alias("c"), F.max((F.col("grouped") < F.col("capped")).cast("int")).alias("g"),
    )
    per = per_group.groupBy("date").agg(
        F.sum("before").alias("gross_before"), F.sum("after").alias("gross_after"), F.max("top").alias("largest_weight"), F.coalesce(F.max(F.when(F.col("group").isNotNull(), F.col("after"))), F.lit(0.0)).alias("largest_group"),
        F.max("volatility").alias("volatility"), F.max("drawdown").alias("drawdown"), *[F.max(k).alias(k) for k in "bcg"],
    )
    bound = F.array_compact(
        F.array(
            F.when(F.col("b") == 1, "blacklist"),
            F.when((F.col("drawdown") <= -abs(limits.drawdown)) & F.lit(limits.drawdown > 0), "drawdown_circuit_breaker"),
            F.when(F.col("c") == 1, "max_single_weight"),
            F.when(F.col("g") == 1, "max_theme_weight"),
            F.when((F.col("volatility") > limits.volatility) & F.lit(limits.volatility > 0), "volatility_target"),
        )
    )
    return per.select("date", "gross_before", "gross_after", F.greatest(F.lit(0.0), 1 - F.col("gross_after")).alias("cash_after"), "largest_weight", "largest_group", "volatility", "drawdown", F.when(F.size(bound) == 0, "none").otherwise(F.array_join(bound, ";")).alias("applied"))


@dataclass(frozen=True)
class EventRisk:
    most_risk_events: int = 0
    least_impact: float = -0.35
    least_confidence: float = 0.5
    scale: float = 0.5
    block_new: bool = True
    max_age: int = 20


def event_guard(targets: DataFrame, factors: DataFrame, risk: EventRisk) -> DataFrame:
    """(date, symbol, original, weight, action, reason): targets lowered or not entered where the symbol's newest events are adverse.

    factors: one row per date and symbol with event_risk_count, negative_event_count, event_impact_score,
    event_weighted_impact_score and event_confidence_mean; the newest at most max_age days old counts. A severe event
    blocks a holding that is new, i.e. was not held, or was blocked, on the rebalance date before. Whether it was is no
    recursion: within a run of dates on which a symbol is wanted, it is held from the first date without a severe event on.
    """
    if not 0 < risk.scale <= 1:
        raise ValueError("scale must lie in (0, 1]")
    wanted = targets.where("weight > 0").select("date", "symbol", F.col("weight").alias("original"))
    fields = ["event_risk_count", "negative_event_count", "impact", "event_confidence_mean"]
    impact = F.coalesce("event_weighted_impact_score", "event_impact_score").alias("impact")
    newest = latest_within(wanted.select("symbol", "date"), factors.select("symbol", "date", "event_risk_count", "negative_event_count", impact, "event_confidence_mean"), risk.max_age, fields)
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    sure = F.col("event_date").isNotNull() & (zero("event_confidence_mean") >= risk.least_confidence)
    marks = {
        "event_risk_count_threshold": sure & (zero("event_risk_count") > risk.most_risk_events),
        "negative_event_impact_threshold": sure & (zero("impact") <= risk.least_impact),
        "negative_event_count": sure & (zero("negative_event_count") > 0) & (zero("impact") < 0),
    }
    rows = wanted.join(newest, ["symbol", "date"]).select("date", "symbol", "original", *[m.alias(n) for n, m in marks.items()])
    severe = F.col("negative_event_impact_threshold") | F.col("negative_event_count")
    numbered = targets.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("i"))  # a calendar
    order = Window.partitionBy("symbol").orderBy("i")
    rows = rows.join(F.broadcast(numbered), "date").withColumn("run", F.col("i") - F.row_number().over(order))
    earlier = Window.partitionBy("symbol", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max((~severe).cast("int")).over(earlier), F.lit(0)) == 1
    rows = rows.withColumn("blocked", severe & ~held & F.lit(risk.block_new))
    adverse = severe | F.col("event_risk_count_threshold")
    action = F.when(F.col("blocked"), "block_new_buy").when(adverse, "reduce_weight").otherwise("none")
    weight = F.when(F.col("blocked"), 0.0).when(adverse, F.col("original") * risk.scale).otherwise(F.col("original"))
    reason = F.array_join(F.array_compact(F.array(*[F.when(F.col(n), n) for n in marks])), ";")
    return rows.select("date", "symbol", "original", weight.alias("weight"), action.alias("action"), reason.alias("reason"))


def annual_metrics(curve: DataFrame, year_days: int = 252) -> DataFrame:
    """Per year of an equity curve (date, equity, daily_return, drawdown): first and last equity, return, volatility, Sharpe ratio and worst drawdown."""
    s, m, n = F.stddev_pop("daily_return"), F.avg("daily_return"), F.count("daily_return")
    per = curve.groupBy(F.year("date").alias("year")).agg(
        F.min_by("equity", "date").alias("start_equity"), F.max_by("equity", "date").alias("end_equity"), F.when(n > 1, s * F.sqrt(F.lit(float(year_days)))).otherwise(0.0).alias("annual_volatility"),
        F.when(s > 0, m / s * F.sqrt(F.lit(float(year_days)))).otherwise(0.0).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("trading_days"),
    )
    gain = F.when(F.col("start_equity") > 0, F.col("end_equity") / F.col("start_equity") - 1).otherwise(0.0)
    return per.withColumn("year_return", gain).withColumn("stability_status", F.when(F.col("max_drawdown") <= -0.20, "drawdown_watch").when(F.col("year_return") > 0, "positive").otherwise("negative"))


def cost_summary(trades: DataFrame, slippage: float) -> DataFrame:
    """(scope, trade_count, gross_value, fee, tax, estimated_slippage_cost, total_cost, avg_cost_bps) of all trades and of each side, in one pass.

    trades: side, gross_value, fee, tax; nulls count as 0, sides as they are written but for letter case. Always three rows.
    """
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    gross = F.abs(zero("gross_value"))
    scopes = F.explode(F.array(F.lit("all"), F.lower("side"))).alias("scope")
    rows = trades.select(scopes, gross.alias("g"), zero("fee").alias("f"), zero("tax").alias("t"))
    sums = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("trade_count"), F.sum("g").alias("g"), F.sum("f").alias("f"), F.sum("t").alias("t"))
    every = trades.sparkSession.createDataFrame([("all",), ("buy",), ("sell",)], "scope string")
    got = every.join(sums, "scope", "left").select("scope", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), zero("g").alias("gross_value"), zero("f").alias("fee"), zero("t").alias("tax"), (zero("g") * slippage).alias("estimated_slippage_cost"))
    cost = F.col("fee") + F.col("tax") + F.col("estimated_slippage_cost")
    return got.withColumn("total_cost", cost).withColumn("avg_cost_bps", F.when(F.col("gross_value") > 0, cost / F.col("gross_value") * 10_000).otherwise(0.0))


def range_scale(bars: DataFrame, days: int = 20) -> DataFrame:
    """(symbol, scale): the middle of a symbol's recent median true range and return deviation, from 0.003 to 0.08; 0.02 without either."""
    pc = F.lag("close").over(by_symbol())
    moved = bars.select("symbol", "date", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)).alias("tr"), "close", (F.try_divide("close", pc) - 1).alias("r"))
    newest = moved.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("n") <= days)
    per = newest.groupBy("symbol").agg(F.percentile(F.try_divide("tr", "close"), 0.5).alias("a"), F.stddev_samp("r").alias("b"))
    a, b = F.when(F.col("a") > 0, F.col("a")), F.when(F.col("b") > 0, F.col("b"))
    middle = F.coalesce((a + b) / 2, a, b, F.lit(0.02))
    return per.select("symbol", F.least(F.lit(0.08), F.greatest(F.lit(0.003), middle)).alias("scale"))


def rank_within(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """rows with rank_ and share_: place within the group from the greatest value down, ties alike, and as a share of the known values. Null values have none."""
    order = Window.partitionBy(*groups).orderBy(F.col(value).desc_nulls_last())
    known = F.count(value).over(Window.partitionBy(*groups))
    rank = F.when(F.col(value).isNotNull(), F.rank().over(order))
    return rows.withColumns({"rank_": rank, "share_": F.try_divide(rank, known)})


def symbol_backtest(rows: DataFrame) -> DataFrame:
    """Per symbol: rows, accuracy, Brier score, rank correlation, mean returns of the most and least likely fifth, and the worst fall of the compounded returns.

    rows: symbol, date, prob_up, direction, label. A symbol's rows are bounded by its calendar.
    """
    from barloom.functions.rolling import pearson, rank_average

    known = rows.where("prob_up IS NOT NULL AND direction IS NOT NULL AND label IS NOT NULL")
    cuts = known.groupBy("symbol").agg(F.percentile("prob_up", F.array(F.lit(0.8), F.lit(0.2))).alias("q"))
    grown = F.sum(F.log(1 + F.greatest("label", F.lit(-0.999)))).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    each = known.withColumns({"wealth": F.exp(grown), "pr": rank_average(F.col("prob_up"), "symbol"), "lr": rank_average(F.col("label"), "symbol")})
    each = each.withColumn("fall", F.col("wealth") / F.max("wealth").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) - 1).join(cuts, "symbol")
    right = ((F.col("prob_up") >= 0.5).cast("double") == F.col("direction")).cast("double")
    return each.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(right).alias("direction_accuracy"), F.avg(F.pow(F.col("prob_up") - F.col("direction"), 2)).alias("brier"), F.coalesce(pearson("pr", "lr"), F.lit(0.0)).alias("return_ic"),
        F.avg(F.when(F.col("prob_up") >= F.col("q")[0], F.col("label"))).alias("top_bucket_return"), F.avg(F.when(F.col("prob_up") <= F.col("q")[1], F.col("label"))).alias("bottom_bucket_return"), F.min("fall").alias("max_forward_drawdown"),
    )
