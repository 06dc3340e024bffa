"""Queries on feature tables and what joins them, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators.factors import factor_panel
from barloom.plans.research import CHOSEN, PANEL, _SCORE, panel, rounded, scores, tidy, with_final
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, bars

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


_NUMBERS = [x for x in X.EVENT_NUMBERS]
_LAST = f"""WITH lf AS (SELECT * FROM stock_event_factors WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY row_id DESC) = 1),
db AS (SELECT date, symbol, arg_max(close, row_id) AS close FROM (SELECT * REPLACE (CASE WHEN isnan(close) THEN NULL ELSE close END AS close) FROM daily_bar WHERE date IS NOT NULL AND close IS NOT NULL) GROUP BY 1, 2),
jf AS (SELECT db.date, db.symbol, db.close, {', '.join(f'CAST(coalesce(lf.{x}, 0) AS DOUBLE) AS {x}' for x in _NUMBERS)}, coalesce(latest_event_type, '') AS latest_event_type, coalesce(latest_event_title, '') AS latest_event_title FROM db LEFT JOIN lf ON lf.date = db.date AND lf.symbol = db.symbol)"""


def event_panel(spark: SparkSession, root: str) -> DataFrame:
    closes = table(spark, root, "daily_bar").where("date IS NOT NULL AND close IS NOT NULL").groupBy("date", "symbol").agg(F.max_by("close", "row_id").alias("close"))
    return X.with_event_factors(closes, table(spark, root, "stock_event_factors"), "row_id")


@query(with_final(_LAST, "SELECT * FROM jf", "close " + " ".join(_NUMBERS)), dates="date")
def panel_with_events(spark: SparkSession, root: str) -> DataFrame:
    """Closes with the event columns of their date and symbol."""
    return tidy(event_panel(spark, root))


_AUDIT = " UNION ALL ".join(f"SELECT '{x}' AS feature, count({x}) / count(*) AS coverage, count(*) FILTER (WHERE abs(coalesce({x}, 0)) > 1e-12) / count(*) AS nonzero_ratio, avg(abs(coalesce({x}, 0))) AS mean_abs_value, count(DISTINCT {x}) AS distinct_values FROM stock_event_factors" for x in _NUMBERS)


@query(with_final(f"WITH a AS ({_AUDIT} UNION ALL SELECT 'absent', 0, 0, 0, 0), b AS (SELECT *, concat_ws(';', CASE WHEN feature = 'absent' THEN 'missing_feature_column' WHEN coverage < 0.95 THEN 'low_matrix_coverage' END, CASE WHEN feature <> 'absent' AND nonzero_ratio <= 0 THEN 'all_zero_event_feature' WHEN nonzero_ratio > 0 AND nonzero_ratio < 0.01 THEN 'sparse_event_signal' END, CASE WHEN feature <> 'absent' AND distinct_values < 2 THEN 'constant_event_feature' END) AS f FROM a)",
    "SELECT feature, coverage, nonzero_ratio, mean_abs_value, distinct_values, CASE WHEN f = '' THEN 'approved' WHEN f LIKE '%missing_feature%' OR f LIKE '%all_zero%' OR f LIKE '%constant%' THEN 'quarantine' ELSE 'watchlist' END AS quality_status, CASE WHEN f = '' THEN 'passed' ELSE f END AS failed_reasons FROM b", "coverage nonzero_ratio mean_abs_value"))
def event_feature_audit(spark: SparkSession, root: str) -> DataFrame:
    return tidy(X.feature_audit(table(spark, root, "stock_event_factors"), [*_NUMBERS, "absent"]))


def _store(spark: SparkSession, root: str) -> DataFrame:
    p = panel(spark, root)
    events = table(spark, root, "stock_event_factors")
    return X.feature_store(p.select("date", "symbol", *CHOSEN), p.select("date", "symbol", "label"), events, sequence="row_id", features=CHOSEN, horizons=[5], source="bars")




@query(with_final(f"WITH {PANEL}, lf AS (SELECT * FROM stock_event_factors WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY row_id DESC) = 1)",
    f"SELECT p.date, p.symbol, {', '.join(CHOSEN)}, label, {', '.join(f'CAST(coalesce(lf.{x}, 0) AS DOUBLE) AS {x}' for x in _NUMBERS)}, coalesce(latest_event_type, '') AS latest_event_type, coalesce(latest_event_title, '') AS latest_event_title, 'bars' AS source, substring(sha1('bars|{','.join(CHOSEN)}|5'), 1, 12) AS feature_version, p.date AS effective_date FROM panel p LEFT JOIN lf ON lf.date = p.date AND lf.symbol = p.symbol",
    f"label {' '.join(CHOSEN)} {' '.join(_NUMBERS)}", 5), dates="date effective_date")
def feature_store(spark: SparkSession, root: str) -> DataFrame:
    """Factors, labels and event columns of every bar, with version and date in force."""
    return tidy(_store(spark, root), 5)


_SHARES = " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) / count(*) AS c FROM panel" for f in CHOSEN)


@query(f"WITH {PANEL}, sh AS ({_SHARES}) SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date, (SELECT coalesce(string_agg(feature, ';' ORDER BY c, feature), '') FROM sh WHERE c < 0.97) AS low_coverage_features, CAST({len(CHOSEN)} AS INTEGER) AS feature_count FROM panel")
def feature_store_summary(spark: SparkSession, root: str) -> DataFrame:
    return tidy(X.store_summary(panel(spark, root), CHOSEN, 0.97))


@query("SELECT count(*) AS entities, sha1(string_agg(t, '|' ORDER BY t)) AS digest FROM (SELECT concat_ws(':', symbol, strftime(min(date), '%Y-%m-%d'), strftime(max(date), '%Y-%m-%d'), CAST(count(*) AS VARCHAR)) AS t FROM daily_bar GROUP BY symbol)")
def data_digest(spark: SparkSession, root: str) -> DataFrame:
    return X.data_digest(table(spark, root, "daily_bar"), "symbol", "date")


@query("SELECT count(*) AS rows, count(DISTINCT row_id) AS distinct_ids, count(source) AS sources, count(effective_date) AS effective, CAST(0 AS BIGINT) AS announced, true AS hashes_differ FROM (SELECT *, date AS effective_date FROM daily_bar)")
def audited_bars(spark: SparkSession, root: str) -> DataFrame:
    """daily_bar with audit columns, in figures: the hash itself is of no use to another engine."""
    df = X.audit_columns(table(spark, root, "daily_bar"), "exchange")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("distinct_ids"), F.count("source").alias("sources"), F.count("effective_date").alias("effective"), F.count("announce_date").alias("announced"), (F.count_distinct("audit_raw_hash") == F.count_distinct("row_id")).alias("hashes_differ"))


@query(with_final(f"WITH {PANEL}", f"SELECT date, symbol, {', '.join(f'CASE WHEN stddev_samp({f}) OVER (PARTITION BY date) > 0 THEN ({f} - avg({f}) OVER (PARTITION BY date)) / stddev_samp({f}) OVER (PARTITION BY date) END AS {f}_zscore' for f in ('momentum_20', 'intraday_return'))} FROM panel", "momentum_20_zscore intraday_return_zscore"), dates="date")
def cross_section_zscore(spark: SparkSession, root: str) -> DataFrame:
    p = factor_panel(bars(spark, root), ["momentum_20", "intraday_return"])
    return tidy(X.z_scores(p, ["momentum_20", "intraday_return"]).select("date", "symbol", "momentum_20_zscore", "intraday_return_zscore"))


@query(with_final(f"WITH {PANEL}, m AS (SELECT date, symbol, coalesce(momentum_20, 0) AS v, avg(coalesce(momentum_20, 0)) OVER (PARTITION BY date) AS m, stddev_pop(coalesce(momentum_20, 0)) OVER (PARTITION BY date) AS s FROM panel)", "SELECT date, symbol, greatest(0.05, least(0.95, 1 / (1 + exp(-(v - m) / CASE WHEN s > 0 THEN s ELSE 1 END)))) AS prob_up FROM m", "prob_up"), dates="date")
def squashed_returns(spark: SparkSession, root: str) -> DataFrame:
    p = factor_panel(bars(spark, root), ["momentum_20"])
    return tidy(X.squashed(p, ["date"], "momentum_20").select("date", "symbol", "prob_up"))


@query("SELECT symbol, strftime(latest_date, '%Y-%m-%d') AS latest_date, horizon_days, row_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, latest_date ORDER BY abs(horizon_days - 7), horizon_days, row_id) AS k FROM stock_forecast WHERE horizon_days IS NOT NULL) WHERE k = 1")
def nearest_forecast(spark: SparkSession, root: str) -> DataFrame:
    """Of each symbol's forecasts of a day the one whose horizon is closest to seven days."""
    rows = table(spark, root, "stock_forecast").groupBy("symbol", "latest_date", "horizon_days").agg(F.min("row_id").alias("row_id"))
    return tidy(X.nearest_horizon(rows, ["symbol", "latest_date"], "horizon_days", 7))


@query("""WITH c AS (SELECT s.symbol, n FROM (SELECT DISTINCT symbol FROM daily_bar) s LEFT JOIN (SELECT symbol, count(*) AS n FROM stock_event_store GROUP BY 1) USING (symbol)),
k AS (SELECT symbol FROM c ORDER BY symbol = '900001' DESC, n DESC NULLS LAST, symbol LIMIT 6)
SELECT row_id, symbol FROM stock_event_store WHERE symbol IN (SELECT symbol FROM k) ORDER BY symbol = '900001' DESC, coalesce(source_reliability, 0) DESC, coalesce(entity_link_confidence, 0) DESC, abs(coalesce(weighted_impact_score, 0)) DESC, published_at DESC NULLS LAST, row_id LIMIT 500""")
def impact_scope(spark: SparkSession, root: str) -> DataFrame:
    """The 500 events that matter most to a report on one symbol and five others."""
    return X.limited_scope(table(spark, root, "stock_event_store"), table(spark, root, "daily_bar"), "900001", 6, 500).select("row_id", "symbol")


@query(rounded("WITH d AS (SELECT DISTINCT latest_date FROM stock_forecast WHERE latest_date IS NOT NULL), m AS (SELECT latest_date, k, CAST(round_even(k * 240.0 / 15, 0) AS INT) AS minute FROM d, (SELECT unnest(generate_series(0, 15)) AS k)), c AS (SELECT *, CASE WHEN minute <= 120 THEN 570 + minute ELSE 660 + minute END AS clock FROM m) SELECT strftime(latest_date, '%Y-%m-%d') AS latest_date, printf('%02d:%02d', CAST(floor(clock / 60) AS INT), clock % 60) AS label, minute / 240.0 AS progress, CASE WHEN k IN (0, 15) THEN 0 ELSE sin(minute / 240.0 * 2.5 * pi()) * (1 - abs(minute / 240.0 - 0.55) * 0.55) END AS wave FROM c", "progress wave"))
def intraday_path(spark: SparkSession, root: str) -> DataFrame:
    """Sixteen moments of the session of every forecast day."""
    days = table(spark, root, "stock_forecast").select("latest_date").where("latest_date IS NOT NULL").distinct()
    return tidy(X.intraday_checkpoints(days, 16))


@query(f"WITH {BARS_SQL}, dd AS (SELECT DISTINCT date FROM bars), n AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM dd) SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN n < 30 OR i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM n")
def time_split(spark: SparkSession, root: str) -> DataFrame:
    return tidy(X.fitted_split(bars(spark, root)))


@query(f"WITH {BARS_SQL}, dd AS (SELECT DISTINCT year(date) AS year, date FROM bars), n AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY date) AS i, count(*) OVER (PARTITION BY year) AS n FROM dd), s AS (SELECT *, n - greatest(20, floor(n * 0.2)) AS a FROM n) SELECT CAST(year AS INTEGER) AS year, strftime(date, '%Y-%m-%d') AS date, CASE WHEN n < 60 OR a - 10 < 20 OR i <= a - 10 THEN 'model' WHEN i > a THEN 'calibration' ELSE 'embargo' END AS role FROM s")
def inner_calibration_split(spark: SparkSession, root: str) -> DataFrame:
    """Dates of every year that fit a model and that calibrate it."""
    dates = bars(spark, root).select(F.year("date").alias("year"), "date")
    return tidy(X.calibration_split(dates, 10, ["year"]))


@query(with_final(_SCORE + ", ls AS (SELECT symbol, max(date) AS date, arg_max(score, date) AS score FROM sc WHERE score IS NOT NULL GROUP BY 1), lm AS (SELECT symbol, arg_max(momentum_20, date) AS momentum_20, arg_max(volatility_20, date) AS volatility_20 FROM panel GROUP BY 1)", "SELECT ls.symbol, date, score, momentum_20, volatility_20 FROM ls LEFT JOIN lm ON lm.symbol = ls.symbol", "score momentum_20 volatility_20"), dates="date")
def latest_scores(spark: SparkSession, root: str) -> DataFrame:
    """Each symbol's latest score with its latest factors."""
    newest = scores(spark, root).groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("score", "date").alias("score"))
    factors = factor_panel(bars(spark, root), ["momentum_20", "volatility_20"]).groupBy("symbol").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("date"))).alias(f) for f in ("momentum_20", "volatility_20")])
    return tidy(newest.join(factors, "symbol", "left"))
