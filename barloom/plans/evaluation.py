"""Queries on predictions, forecasts, neighbours and simulated portfolios, with SQL where SQL can state their results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import analysis as A
from barloom.operators import evaluation as V
from barloom.operators import portfolio as P
from barloom.operators import ridge
from barloom.functions.rolling import rank_share
from barloom.operators.factors import FACTORS
from barloom.operators.vectors import release
from barloom.operators.wide import bucket_count, over_buckets
from barloom.plans.research import _SCORE, CHOSEN, WEIGHTS, most_bars, panel, rounded, sql_corr, sql_rank, targets, tidy, with_final
from barloom.session import cut_lineage
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, bars

QUERIES: dict = {}
SQL: dict[str, str] = {}
TRAIN, TEST, EMBARGO = 504, 63, 10


def query(sql: str | None = None, dates: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


def scored(spark: SparkSession, root: str) -> DataFrame:
    """(date, symbol, score, label, direction)."""
    s = A.factor_scores(panel(spark, root), WEIGHTS, ("label",)).select("date", "symbol", F.round("score", 9).alias("score"), "label")
    return s.withColumn("direction", F.when(F.col("label").isNotNull(), (F.col("label") > 0).cast("double")))


def predictions(spark: SparkSession, root: str) -> DataFrame:
    rows = scored(spark, root)
    folds = V.walk_forward_folds(bars(spark, root), TRAIN, TEST, EMBARGO)
    return V.baseline_predictions(rows, folds)


_FOLDS = f""", nd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)),
fo AS (SELECT unnest(generate_series(0, CAST(floor(((SELECT max(i) FROM nd) - {TRAIN}) / {TEST}) AS BIGINT))) AS fold WHERE (SELECT max(i) FROM nd) >= {TRAIN}),
folds AS (SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN i >= {TRAIN} + fold * {TEST} THEN 'test' ELSE 'train' END AS role, date FROM fo, nd
  WHERE (i >= {TRAIN} + fold * {TEST} AND i < {TRAIN} + (fold + 1) * {TEST}) OR (i >= fold * {TEST} AND i < {TRAIN} + fold * {TEST} - {EMBARGO}))"""
_PREDICTIONS = _SCORE + _FOLDS + f""",
rows0 AS (SELECT s.date, s.symbol, round(s.score, 9) AS score, p.label, CASE WHEN p.label > 0 THEN 1.0 ELSE 0.0 END AS direction FROM sc s JOIN panel p ON p.date = s.date AND p.symbol = s.symbol WHERE p.label IS NOT NULL),
tr AS (SELECT fold, avg(direction) AS base, stddev_pop(label) AS spread FROM rows0 JOIN folds USING (date) WHERE role = 'train' GROUP BY 1),
pl AS (SELECT *, {sql_rank('score', 'date')} / count(*) OVER (PARTITION BY date) - 0.5 AS place FROM rows0),
pred AS (SELECT f.fold, p.date, p.symbol, p.label, CAST(p.direction AS DOUBLE) AS direction, greatest(0.05, least(0.95, base + place * 0.20)) AS prob_up, place * spread AS predicted_return FROM pl p JOIN folds f ON f.date = p.date AND f.role = 'test' JOIN tr ON tr.fold = f.fold)"""


@query(f"WITH {BARS_SQL}{_FOLDS} SELECT * FROM folds", dates="date")
def wf_folds(spark: SparkSession, root: str) -> DataFrame:
    return tidy(V.walk_forward_folds(bars(spark, root), TRAIN, TEST, EMBARGO))


@query(with_final(_PREDICTIONS, "SELECT * FROM pred", "label direction prob_up predicted_return"), dates="date")
def wf_baseline_predict(spark: SparkSession, root: str) -> DataFrame:
    return tidy(predictions(spark, root))


def _metrics_sql(group: str) -> str:
    ranked = f""", mp AS (SELECT *, {group} AS slice, round(prob_up, 9) AS p9 FROM pred),
mr AS (SELECT *, {sql_rank('p9', 'slice')} AS pr, {sql_rank('label', 'slice')} AS lr FROM mp),
mq AS (SELECT slice, quantile_cont(p9, 0.8) AS q8, quantile_cont(p9, 0.2) AS q2 FROM mp GROUP BY 1),
mb AS (SELECT slice, least(floor(p9 * 5), 4) AS b, count(*) AS n, abs(avg(p9) - avg(direction)) AS gap FROM mp GROUP BY 1, 2),
me AS (SELECT slice, sum(n * gap) / sum(n) AS ece FROM mb GROUP BY 1)"""
    final = f"""SELECT slice, count(*) AS rows, avg(CASE WHEN (p9 >= 0.5) = (direction = 1) THEN 1.0 ELSE 0.0 END) AS direction_accuracy, greatest(avg(direction), 1 - avg(direction)) AS baseline_accuracy,
coalesce((sum(pr) FILTER (WHERE direction = 1) - sum(direction) * (sum(direction) + 1) / 2) / nullif(sum(direction) * (count(*) - sum(direction)), 0), 0) AS auc, avg((p9 - direction) ** 2) AS brier, coalesce({sql_corr('pr', 'lr')}, 0) AS rank_ic,
avg(label) FILTER (WHERE p9 >= q8) AS top_bucket_return, avg(label) FILTER (WHERE p9 <= q2) AS bottom_bucket_return, any_value(ece) AS ece
FROM mr JOIN mq USING (slice) JOIN me USING (slice) GROUP BY 1"""
    return with_final(_PREDICTIONS + ranked, final, "direction_accuracy baseline_accuracy auc brier rank_ic top_bucket_return bottom_bucket_return ece", 5)


@query(_metrics_sql("CAST(year(date) AS VARCHAR)"))
def slices_year(spark: SparkSession, root: str) -> DataFrame:
    rows = predictions(spark, root).withColumns({"slice": F.year("date").cast("string"), "prob_up": F.round("prob_up", 9)})
    return tidy(V.prediction_metrics(rows, ["slice"]), 5)


@query(_metrics_sql("'all'"))
def prediction_metrics(spark: SparkSession, root: str) -> DataFrame:
    rows = predictions(spark, root).withColumns({"slice": F.lit("all"), "prob_up": F.round("prob_up", 9)})
    return tidy(V.prediction_metrics(rows, ["slice"]), 5)


@query(with_final(_PREDICTIONS, "SELECT fold, CAST(least(floor(round(prob_up, 9) * 5), 4) AS INTEGER) AS bin, count(*) AS rows, avg(prob_up) AS mean_probability, avg(direction) AS observed_rate FROM pred GROUP BY 1, 2", "mean_probability observed_rate"))
def calibration_bins(spark: SparkSession, root: str) -> DataFrame:
    return tidy(V.reliability(predictions(spark, root).withColumn("prob_up", F.round("prob_up", 9)), ["fold"]))


def sliced(spark: SparkSession, root: str) -> DataFrame:
    """Predictions with the year, size bucket, group and regime they fall into."""
    needs = ["amount_mean_20", "market_mean_return", "market_breadth", "volatility_20"]
    traits = panel(spark, root, needs).select("date", "symbol", *[F.round(x, 9 if x != "amount_mean_20" else 5).alias(x) for x in needs], rank_share(F.round("amount_mean_20", 5), "date").alias("cs_amount_rank_20"))
    rows = cut_lineage(predictions(spark, root).join(traits, ["date", "symbol"]).withColumn("prob_up", F.round("prob_up", 9)))
    marked = V.known_regimes(V.size_buckets(rows, None, "cs_amount_rank_20", "amount_mean_20"))
    return marked.withColumns({"year": F.year("date").cast("string"), "theme": F.when(F.col("symbol").cast("int") % 5 < 4, F.concat(F.lit("g"), (F.col("symbol").cast("int") % 5).cast("string")))})


SLICES = ["year", "theme", "size_bucket", "market_regime"]
_SLICED = _PREDICTIONS + f""", mk0 AS (SELECT date, symbol, r, close FROM p0), mk AS (SELECT date, round(avg(r), 9) AS mm, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 9) AS mb FROM mk0 GROUP BY 1),
tr0 AS (SELECT date, symbol, round(amount_mean_20, 5) AS am, round(volatility_20, 9) AS v20 FROM panel),
tr1 AS (SELECT *, CASE WHEN am IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY am NULLS LAST) + (count(*) OVER (PARTITION BY date, am) - 1) / 2.0) / count(am) OVER (PARTITION BY date) END AS car FROM tr0),
mp0 AS (SELECT p.*, round(prob_up, 9) AS p9, mm, mb, v20, car FROM pred p JOIN tr1 ON tr1.date = p.date AND tr1.symbol = p.symbol JOIN mk ON mk.date = p.date),
qs AS (SELECT quantile_cont(mm, 0.33) AS ml, quantile_cont(mm, 0.67) AS mh, quantile_cont(mb, 0.33) AS bl, quantile_cont(mb, 0.67) AS bh, quantile_cont(v20, 0.75) AS vh FROM mp0),
mp1 AS (SELECT mp0.*, CAST(year(date) AS VARCHAR) AS year, coalesce(CASE WHEN CAST(symbol AS INT) % 5 < 4 THEN 'g' || (CAST(symbol AS INT) % 5) END, '(null)') AS theme,
  CASE WHEN car <= 1/3 THEN 'low_liquidity_proxy' WHEN car >= 2/3 THEN 'high_liquidity_proxy' WHEN car IS NOT NULL THEN 'mid_liquidity_proxy' ELSE 'market_cap_unavailable' END AS size_bucket,
  CASE WHEN mm IS NULL OR mb IS NULL THEN 'regime_unavailable' WHEN v20 >= vh THEN 'high_volatility_pit' WHEN mm <= ml AND mb <= bl THEN 'bearish_pit' WHEN mm >= mh AND mb >= bh THEN 'bullish_pit' ELSE 'sideways_pit' END AS market_regime FROM mp0, qs),
mp AS ({' UNION ALL '.join(f"SELECT '{x}' AS slice_type, {x} AS slice, p9, direction, label FROM mp1" for x in SLICES)}),
mr AS (SELECT *, {sql_rank('p9', 'slice_type, slice')} AS pr, {sql_rank('label', 'slice_type, slice')} AS lr FROM mp),
mq AS (SELECT slice_type, slice, quantile_cont(p9, 0.8) AS q8, quantile_cont(p9, 0.2) AS q2 FROM mp GROUP BY 1, 2),
mb2 AS (SELECT slice_type, slice, least(floor(p9 * 5), 4) AS b, count(*) AS n, abs(avg(p9) - avg(direction)) AS gap FROM mp GROUP BY 1, 2, 3),
me AS (SELECT slice_type, slice, sum(n * gap) / sum(n) AS ece FROM mb2 GROUP BY 1, 2)"""


@query(with_final(_SLICED, f"""SELECT slice_type, slice, count(*) AS rows, avg(CASE WHEN (p9 >= 0.5) = (direction = 1) THEN 1.0 ELSE 0.0 END) AS direction_accuracy, greatest(avg(direction), 1 - avg(direction)) AS baseline_accuracy,
coalesce((sum(pr) FILTER (WHERE direction = 1) - sum(direction) * (sum(direction) + 1) / 2) / nullif(sum(direction) * (count(*) - sum(direction)), 0), 0) AS auc, avg((p9 - direction) ** 2) AS brier, coalesce({sql_corr('pr', 'lr')}, 0) AS rank_ic,
avg(label) FILTER (WHERE p9 >= q8) AS top_bucket_return, avg(label) FILTER (WHERE p9 <= q2) AS bottom_bucket_return, any_value(ece) AS ece
FROM mr JOIN mq USING (slice_type, slice) JOIN me USING (slice_type, slice) GROUP BY 1, 2""", "direction_accuracy baseline_accuracy auc brier rank_ic top_bucket_return bottom_bucket_return ece", 5))
def prediction_slices(spark: SparkSession, root: str) -> DataFrame:
    """Metrics by year, group, size and regime, in one pass."""
    return tidy(V.slice_metrics(sliced(spark, root), SLICES), 5)


def _raw(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(predictions(spark, root))
    following = rows.withColumn("fold", F.col("fold") + 1)  # what a fold predicted calibrates the next
    return rows, V.fold_calibrations(following, ["fold"])


@query()
def calibration_fits(spark: SparkSession, root: str) -> DataFrame:
    """Per fold the calibration chosen on the fold before it, with scores."""
    return _raw(spark, root)[1].drop("curve")


@query()
def calibrated_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Predictions with probabilities calibrated on the fold before."""
    rows, fits = _raw(spark, root)
    return tidy(V.calibrated(rows, fits, ["fold"]))


@query()
def mllib_ridge(spark: SparkSession, root: str) -> DataFrame:
    """Ridge forecasts, on every factor, of the dates after 2000-01-01 from those before, as MLlib fits them.

    The factors of a bar are computed twice, for the sums of the fit and for its forecast, and never written.
    """
    most, until, horizon = most_bars(spark, root), date(2000, 1, 1), 5

    def rows(part: pa.Table, values: dict[str, np.ndarray], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        close = values["close"]
        left = np.repeat([*starts[1:], len(close)], np.diff([*starts, len(close)])) - np.arange(len(close)) - 1
        label = np.full(len(close), np.nan)
        at = np.flatnonzero(left >= horizon)
        with np.errstate(all="ignore"):
            label[at] = close[at + horizon] / np.where(close[at] == 0, np.nan, close[at]) - 1
        return np.column_stack([values[n] for n in FACTORS]), label, pc.less(part["date"], pa.scalar(until)).to_numpy(zero_copy_only=False).astype(bool)

    def sums(part: pa.Table, values: dict[str, np.ndarray], starts: list[int]) -> pa.Table:
        x, label, train = rows(part, values, starts)
        at = train & ~np.isnan(label)
        return pa.table({"s": pa.array([ridge.moments(np.column_stack([x[at], label[at]]))] if at.any() else [], pa.binary())})

    spread = bars(spark, root, bucket_count(most))
    plan = over_buckets(spread, most, FACTORS)
    means, weights, level = ridge.fitted(ridge.collected(plan(sums, "s binary")))
    release(spark)

    def told(part: pa.Table, values: dict[str, np.ndarray], starts: list[int]) -> pa.Table:
        x, label, train = rows(part, values, starts)
        at = np.flatnonzero(~train)
        part = part.take(pa.array(at))
        return pa.table({"date": part["date"].cast(pa.date32()), "symbol": part["symbol"].cast(pa.string()), "label": pa.array(label[at], from_pandas=True), "prediction": pa.array(ridge.predicted(x[at], means, weights, level), from_pandas=True)})

    return plan(told, "date date, symbol string, label double, prediction double")


_OLS = _SCORE + """, rows0 AS (SELECT s.symbol, s.date, round(s.score, 9) AS x, p.label FROM sc s JOIN panel p ON p.date = s.date AND p.symbol = s.symbol),
ol AS (SELECT symbol, count(*) AS rows, avg(label) AS my, avg(x) AS mx, CASE WHEN count(*) >= 20 THEN coalesce(covar_pop(label, x) / nullif(var_pop(x), 0), 0) ELSE 0 END AS beta FROM rows0 WHERE label IS NOT NULL GROUP BY 1)"""


@query(with_final(_OLS, "SELECT o.symbol, o.rows, my - beta * mx AS alpha, beta, my - beta * mx + beta * l.x AS expected_return FROM ol o JOIN (SELECT symbol, arg_max(x, date) AS x FROM rows0 GROUP BY 1) l USING (symbol)", "alpha beta expected_return"))
def ols_forecast(spark: SparkSession, root: str) -> DataFrame:
    rows = scored(spark, root).withColumnRenamed("score", "x")
    last = rows.groupBy("symbol").agg(F.max_by("x", "date").alias("latest"))
    lines = V.line_by_symbol(rows).join(last, "symbol")
    return tidy(lines.select("symbol", "rows", "alpha", "beta", (F.col("alpha") + F.col("beta") * F.col("latest")).alias("expected_return")))


@query(with_final(_OLS + ", ce AS (SELECT symbol, quantile_cont(label, 0.5) AS c, count(*) AS n FROM rows0 WHERE label IS NOT NULL GROUP BY 1), di AS (SELECT r.symbol, abs(label - c) AS d, n, row_number() OVER (PARTITION BY r.symbol ORDER BY abs(label - c)) AS k FROM rows0 r JOIN ce USING (symbol) WHERE label IS NOT NULL)", "SELECT symbol, n AS rows, max(d) FILTER (WHERE n >= 80 AND k = least(n, ceil((n + 1) * 0.8))) AS half_width FROM di GROUP BY 1, 2", "half_width"))
def conformal_interval(spark: SparkSession, root: str) -> DataFrame:
    return tidy(V.conformal_width(scored(spark, root)))


_Z = " UNION ALL ".join(f"SELECT symbol, '{f}' AS factor, (arg_max_null({f}, date) - avg({f})) / nullif(stddev_pop({f}), 0) AS z FROM panel GROUP BY 1" for f in CHOSEN)


@query(with_final(_SCORE + f", z AS ({_Z}), zp AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY round(abs(z), 9) DESC, factor) AS INTEGER) AS place FROM z WHERE z IS NOT NULL)", "SELECT * FROM zp WHERE place <= 3", "z"))
def factor_contributors(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(V.contributors(panel(spark, root, factors), factors, 3))


QUERIES["factor_contributors_all"] = partial(factor_contributors, factors=FACTORS)


@query(with_final("WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS place FROM d)", "SELECT * FROM k WHERE place <= 5", "distance"))
def nearest_states(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, root, "embeddings")
    return tidy(V.nearest(vectors, vectors.where("vec_id % 20 = 0"), row_id="vec_id", vector="embedding", k=5))


_STATES = ["momentum_20", "reversal_5", "volatility_20", "amount_mean_20", "intraday_return"]
_DISTANCE = " + ".join(f"power(coalesce((h.{f} - m_{f}) / nullif(s_{f}, 0), 0) - coalesce((l.{f} - m_{f}) / nullif(s_{f}, 0), 0), 2)" for f in _STATES)


@query(with_final(_SCORE + f""", la AS (SELECT symbol, max(date) AS d FROM panel GROUP BY 1), l AS (SELECT p.* FROM panel p JOIN la ON la.symbol = p.symbol AND la.d = p.date), h AS (SELECT p.* FROM panel p JOIN la ON la.symbol = p.symbol AND p.date < la.d),
st AS (SELECT symbol, {', '.join(f'avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}' for f in _STATES)} FROM h GROUP BY 1),
di AS (SELECT h.symbol, h.date, sqrt({_DISTANCE}) AS distance FROM h JOIN l ON l.symbol = h.symbol JOIN st ON st.symbol = h.symbol WHERE {' AND '.join(f'l.{f} IS NOT NULL' for f in _STATES)})""",
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY round(distance, 9), date) AS INTEGER) AS place FROM di) WHERE place <= 20", "distance", 5), dates="date")
def similar_states(spark: SparkSession, root: str) -> DataFrame:
    """The twenty earlier dates of each symbol most like its latest one."""
    return tidy(V.similar_states(panel(spark, root).select("symbol", "date", *_STATES), _STATES), 5)


@query(rounded("SELECT model_type, horizon_days, count(*) AS rows, coalesce(string_agg(DISTINCT probability_calibration_status, ';' ORDER BY probability_calibration_status), '') AS statuses, count(DISTINCT probability_calibration_status) > 1 AS mixed, avg(CASE WHEN contains(coalesce(probability_calibration_status, ''), 'sparse') THEN 1.0 ELSE 0.0 END) AS fallback_rate FROM stock_forecast GROUP BY 1, 2", "fallback_rate"))
def model_audit(spark: SparkSession, root: str) -> DataFrame:
    """Calibration statuses of the forecasts by model and horizon."""
    return tidy(V.status_summary(table(spark, root, "stock_forecast"), ["model_type", "horizon_days"], "probability_calibration_status", "sparse"))


@query()
def targets_capped(spark: SparkSession, root: str) -> DataFrame:
    """Weekly targets with turnover capped at a half, at one, and not at all."""
    return P.capped_targets(targets(spark, root), {"half": 0.5, "one": 1.0, "free": 99.0})


@query()
def backtest_ledger(spark: SparkSession, root: str) -> DataFrame:
    return P.simulate(targets_capped(spark, root), bars(spark, root), P.Costs())


@query()
def backtest_metrics(spark: SparkSession, root: str) -> DataFrame:
    return P.equity_metrics(backtest_ledger(spark, root))
