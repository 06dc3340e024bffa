"""Queries on limits of target weights, costs and equity curves, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import by_symbol
from barloom.operators import risk as R
from barloom.plans.evaluation import _PREDICTIONS, backtest_ledger, predictions
from barloom.plans.events import _HELD, news_factors
from barloom.plans.research import _TARGETS, rounded, sql_corr, sql_rank, targets, tidy, with_final
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, bars

QUERIES: dict = {}
SQL: dict[str, str] = {}
LIMITS = R.Limits(blacklist=("000003",), single=0.18, group=0.35, volatility=0.20, lookback=20, drawdown=0.08, drawdown_scale=0.5)
RISK = R.EventRisk(most_risk_events=0, least_impact=-0.35, least_confidence=0.6, scale=0.5, block_new=True, max_age=60)


def query(sql: str | None = None, dates: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


def market_curve(spark: SparkSession, root: str) -> DataFrame:
    """Equity of all symbols in equal weights, compounded daily."""
    r = F.try_divide("close", F.lag("close").over(by_symbol())) - 1
    daily = bars(spark, root).select("date", r.alias("r")).groupBy("date").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("m"))
    grown = F.exp(F.sum(F.log(1 + F.col("m"))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # a calendar
    return R.drawdowns(daily.select("date", F.round(grown, 9).alias("equity")))


_CURVE = """, mr0 AS (SELECT date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars),
mr AS (SELECT date, coalesce(avg(r), 0) AS m FROM mr0 GROUP BY 1),
eq AS (SELECT date, round(exp(sum(ln(1 + m)) OVER (ORDER BY date)), 9) AS equity FROM mr),
curve AS (SELECT date, equity, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS daily_return, max(equity) OVER (ORDER BY date) AS running_max, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM eq)"""


@query(with_final(f"WITH {BARS_SQL}{_CURVE}", "SELECT * FROM curve", "equity daily_return running_max drawdown"), dates="date")
def equity_curve(spark: SparkSession, root: str) -> DataFrame:
    return tidy(market_curve(spark, root))


@query(with_final(f"WITH {BARS_SQL}{_CURVE}, yr AS (SELECT CAST(year(date) AS INTEGER) AS year, arg_min(equity, date) AS start_equity, arg_max(equity, date) AS end_equity, CASE WHEN count(*) > 1 THEN stddev_pop(daily_return) * sqrt(252) ELSE 0 END AS annual_volatility, coalesce(avg(daily_return) / nullif(stddev_pop(daily_return), 0) * sqrt(252), 0) AS sharpe, min(drawdown) AS max_drawdown, count(*) AS trading_days FROM curve GROUP BY 1)",
    "SELECT *, end_equity / start_equity - 1 AS year_return, CASE WHEN max_drawdown <= -0.2 THEN 'drawdown_watch' WHEN end_equity > start_equity THEN 'positive' ELSE 'negative' END AS stability_status FROM yr", "start_equity end_equity annual_volatility sharpe max_drawdown year_return", 5))
def annual_metrics(spark: SparkSession, root: str) -> DataFrame:
    return tidy(R.annual_metrics(market_curve(spark, root)), 5)


@query(with_final("WITH t AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice AS g FROM lineitem), u AS (SELECT 'all' AS scope, * FROM t UNION ALL SELECT side, * FROM t), v AS (SELECT scope, count(*) AS trade_count, sum(g) AS gross_value, sum(g) * 0.0003 AS fee, coalesce(sum(g) FILTER (WHERE side = 'sell'), 0) * 0.001 AS tax, sum(g) * 0.0005 AS estimated_slippage_cost FROM u GROUP BY 1)",
    "SELECT *, fee + tax + estimated_slippage_cost AS total_cost, (fee + tax + estimated_slippage_cost) / gross_value * 10000 AS avg_cost_bps FROM v", "gross_value fee tax estimated_slippage_cost total_cost avg_cost_bps", 3))
def trade_costs(spark: SparkSession, root: str) -> DataFrame:
    """Costs of shipments taken as trades, of all and by side."""
    item = table(spark, root, "lineitem")
    gross, side = F.col("l_extendedprice").cast("double"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL")
    trades = item.select(side.alias("side"), gross.alias("gross_value"), (gross * 0.0003).alias("fee"), F.when(side == "SELL", gross * 0.001).otherwise(0.0).alias("tax"))
    return tidy(R.cost_summary(trades, 0.0005), 3)


def symbol_groups(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("symbol").cast("int") % 5
    return bars(spark, root).select("symbol").distinct().where(k < 4).select("symbol", F.concat(F.lit("g"), k.cast("string")).alias("group"))


def _limited(spark: SparkSession, root: str) -> DataFrame:
    return R.constrained(targets(spark, root), LIMITS, groups=symbol_groups(spark, root), bars=bars(spark, root), curve=market_curve(spark, root))


_LIMITED = _TARGETS + _CURVE + f""",
l1 AS (SELECT date, symbol, CASE WHEN CAST(symbol AS INT) % 5 < 4 THEN 'g' || (CAST(symbol AS INT) % 5) END AS grp, weight AS original, CASE WHEN symbol = '000003' THEN 0 ELSE weight END AS listed FROM tg),
l2 AS (SELECT *, least(listed, {LIMITS.single}) AS capped FROM l1),
gs AS (SELECT date, grp, sum(capped) AS s FROM l2 GROUP BY 1, 2),
l3 AS (SELECT l2.*, CASE WHEN l2.grp IS NOT NULL AND s > {LIMITS.group} THEN capped * {LIMITS.group} / s ELSE capped END AS grouped FROM l2 JOIN gs ON gs.date = l2.date AND gs.grp IS NOT DISTINCT FROM l2.grp),
cal AS (SELECT date AS day, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)),
br AS (SELECT symbol, date AS day, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS r FROM bars),
rd AS (SELECT d.date, c.day FROM (SELECT DISTINCT date FROM l3) d JOIN LATERAL (SELECT max(i) AS m FROM cal WHERE day < d.date) x ON true JOIN cal c ON c.i <= x.m AND c.i > x.m - {LIMITS.lookback}),
rw AS (SELECT l.date, b.day, sum(l.grouped * b.r) AS r FROM l3 l JOIN rd ON rd.date = l.date JOIN br b ON b.symbol = l.symbol AND b.day = rd.day WHERE l.grouped <> 0 GROUP BY 1, 2),
vo AS (SELECT rd.date, CASE WHEN count(*) >= 10 THEN stddev_pop(coalesce(rw.r, 0)) * sqrt(252) END AS volatility FROM rd LEFT JOIN rw ON rw.date = rd.date AND rw.day = rd.day GROUP BY 1),
l4 AS (SELECT l3.date, symbol, grp AS "group", original, listed, capped, grouped, volatility, c.drawdown,
  grouped * CASE WHEN volatility > {LIMITS.volatility} THEN {LIMITS.volatility} / volatility ELSE 1 END * CASE WHEN c.drawdown <= -{LIMITS.drawdown} THEN {LIMITS.drawdown_scale} ELSE 1 END AS weight
  FROM l3 LEFT JOIN vo ON vo.date = l3.date ASOF LEFT JOIN curve c ON l3.date >= c.date)"""


@query(with_final(_LIMITED, "SELECT * FROM l4", "original listed capped grouped volatility drawdown weight"), dates="date")
def constraints_local(spark: SparkSession, root: str) -> DataFrame:
    """Weekly targets after each limit that needs no earlier target."""
    return tidy(_limited(spark, root))


@query(with_final(_LIMITED + f""", sg AS (SELECT date, "group", sum(weight) AS s FROM l4 WHERE "group" IS NOT NULL GROUP BY 1, 2), mg AS (SELECT date, max(s) AS s FROM sg GROUP BY 1)""",
    f"""SELECT l4.date, sum(original) AS gross_before, sum(weight) AS gross_after, greatest(0, 1 - sum(weight)) AS cash_after, max(weight) AS largest_weight, coalesce(any_value(mg.s), 0) AS largest_group, max(volatility) AS volatility, max(drawdown) AS drawdown,
    CASE WHEN concat_ws(';', CASE WHEN bool_or(listed < original) THEN 'x' END, CASE WHEN max(drawdown) <= -{LIMITS.drawdown} THEN 'x' END, CASE WHEN bool_or(capped < listed) THEN 'x' END, CASE WHEN bool_or(grouped < capped) THEN 'x' END, CASE WHEN max(volatility) > {LIMITS.volatility} THEN 'x' END) = '' THEN 'none'
    ELSE concat_ws(';', CASE WHEN bool_or(listed < original) THEN 'blacklist' END, CASE WHEN max(drawdown) <= -{LIMITS.drawdown} THEN 'drawdown_circuit_breaker' END, CASE WHEN bool_or(capped < listed) THEN 'max_single_weight' END, CASE WHEN bool_or(grouped < capped) THEN 'max_theme_weight' END, CASE WHEN max(volatility) > {LIMITS.volatility} THEN 'volatility_target' END) END AS applied
    FROM l4 LEFT JOIN mg ON mg.date = l4.date GROUP BY 1""", "gross_before gross_after cash_after largest_weight largest_group volatility drawdown"), dates="date")
def constraints_daily(spark: SparkSession, root: str) -> DataFrame:
    return tidy(R.constraint_summary(_limited(spark, root), LIMITS))


@query(with_final(_HELD.replace("WITH ", "WITH RECURSIVE ", 1) + f""", nc AS (SELECT symbol, effective_date AS date, avg(confidence) AS conf FROM news GROUP BY 1, 2),
ef AS (SELECT nf.*, conf FROM nf JOIN nc ON nc.symbol = nf.symbol AND nc.date = nf.date),
nw AS (SELECT t.date, t.symbol, t.weight, CASE WHEN e.date >= t.date - {RISK.max_age} THEN e.risk END AS risk, CASE WHEN e.date >= t.date - {RISK.max_age} THEN e.neg END AS neg, CASE WHEN e.date >= t.date - {RISK.max_age} THEN e.i END AS i, CASE WHEN e.date >= t.date - {RISK.max_age} THEN e.conf END AS conf FROM tg t ASOF LEFT JOIN ef e ON e.symbol = t.symbol AND e.date <= t.date),
mk AS (SELECT date, symbol, weight, coalesce(conf >= {RISK.least_confidence} AND risk > {RISK.most_risk_events}, false) AS a, coalesce(conf >= {RISK.least_confidence} AND i <= {RISK.least_impact}, false) AS b, coalesce(conf >= {RISK.least_confidence} AND neg > 0 AND i < 0, false) AS c, dense_rank() OVER (ORDER BY date) AS k FROM nw),
gd AS (SELECT k, symbol, CASE WHEN b OR c THEN 'block_new_buy' WHEN a THEN 'reduce_weight' ELSE 'none' END AS action FROM mk WHERE k = 1
  UNION ALL SELECT m.k, m.symbol, CASE WHEN (b OR c) AND (p.symbol IS NULL OR p.action = 'block_new_buy') THEN 'block_new_buy' WHEN a OR b OR c THEN 'reduce_weight' ELSE 'none' END
  FROM mk m JOIN (SELECT DISTINCT k FROM gd) z ON m.k = z.k + 1 LEFT JOIN gd p ON p.symbol = m.symbol AND p.k = m.k - 1)""",
    "SELECT m.date, m.symbol, m.weight AS original, CASE action WHEN 'block_new_buy' THEN 0 WHEN 'reduce_weight' THEN m.weight * 0.5 ELSE m.weight END AS weight, action, concat_ws(';', CASE WHEN a THEN 'event_risk_count_threshold' END, CASE WHEN b THEN 'negative_event_impact_threshold' END, CASE WHEN c THEN 'negative_event_count' END) AS reason FROM mk m JOIN gd g ON g.k = m.k AND g.symbol = m.symbol", "original weight"), dates="date")
def risk_guard(spark: SparkSession, root: str) -> DataFrame:
    """Weekly targets after the event guard; the SQL states the recursion over dates which the operator resolves by runs."""
    return tidy(R.event_guard(targets(spark, root), news_factors(spark, root), RISK))


@query(with_final(f"WITH {BARS_SQL}, m AS (SELECT symbol, date, close, high, low, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars), p AS (SELECT symbol, quantile_cont(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END / close, 0.5) AS a, stddev_samp(close / pc - 1) AS b FROM m WHERE n <= 20 GROUP BY 1)",
    "SELECT symbol, least(0.08, greatest(0.003, coalesce((nullif(a, 0) + nullif(b, 0)) / 2, nullif(a, 0), nullif(b, 0), 0.02))) AS scale FROM p", "scale"))
def daily_range_scale(spark: SparkSession, root: str) -> DataFrame:
    return tidy(R.range_scale(bars(spark, root)))


@query(with_final(f"WITH {BARS_SQL}, l AS (SELECT date, symbol, CAST(symbol AS INT) % 5 AS g, amount FROM bars)", "SELECT strftime(date, '%Y-%m-%d') AS date, symbol, CAST(rank() OVER (PARTITION BY date, g ORDER BY amount DESC) AS INTEGER) AS rank_, rank() OVER (PARTITION BY date, g ORDER BY amount DESC) / count(*) OVER (PARTITION BY date, g) AS share_ FROM l", "share_"))
def rank_in_group(spark: SparkSession, root: str) -> DataFrame:
    """Place of each bar's amount within its date and group of symbols."""
    rows = bars(spark, root).select("date", "symbol", (F.col("symbol").cast("int") % 5).alias("g"), "amount")
    return tidy(R.rank_within(rows, ["date", "g"], "amount").select("date", "symbol", "rank_", "share_"))


@query(with_final(_PREDICTIONS + f""", sb AS (SELECT *, round(prob_up, 9) AS p9 FROM pred), sr AS (SELECT *, {sql_rank('p9', 'symbol')} AS pr, {sql_rank('label', 'symbol')} AS lr, exp(sum(ln(1 + greatest(label, -0.999))) OVER (PARTITION BY symbol ORDER BY date)) AS wealth FROM sb),
sf AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY symbol ORDER BY date) - 1 AS fall FROM sr), sq AS (SELECT symbol, quantile_cont(p9, 0.8) AS q8, quantile_cont(p9, 0.2) AS q2 FROM sb GROUP BY 1)""",
    f"SELECT symbol, count(*) AS rows, avg(CASE WHEN (p9 >= 0.5) = (direction = 1) THEN 1.0 ELSE 0.0 END) AS direction_accuracy, avg((p9 - direction) ** 2) AS brier, coalesce({sql_corr('pr', 'lr')}, 0) AS return_ic, avg(label) FILTER (WHERE p9 >= q8) AS top_bucket_return, avg(label) FILTER (WHERE p9 <= q2) AS bottom_bucket_return, min(fall) AS max_forward_drawdown FROM sf JOIN sq USING (symbol) GROUP BY 1",
    "direction_accuracy brier return_ic top_bucket_return bottom_bucket_return max_forward_drawdown", 5))
def symbol_backtest(spark: SparkSession, root: str) -> DataFrame:
    return tidy(R.symbol_backtest(predictions(spark, root).withColumn("prob_up", F.round("prob_up", 9))), 5)


@query()
def backtest_costs(spark: SparkSession, root: str) -> DataFrame:
    """Costs of the simulated trades of all scenarios, of all and by side."""
    trades = backtest_ledger(spark, root).where("kind = 'trade'").select(F.when(F.col("shares") > 0, "buy").otherwise("sell").alias("side"), F.abs("value").alias("gross_value"), "fee", "tax")
    return R.cost_summary(trades, 0.0005)
