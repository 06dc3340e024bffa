"""Event queries, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import events as E
from barloom.operators.quality import normalize_bars
from barloom.plans.factors import lag
from barloom.plans.research import _TARGETS, rounded, targets, tidy, with_final
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, NEWS_SQL, bars, news

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


@query("SELECT row_id, event_id, symbol FROM stock_event_store QUALIFY row_number() OVER (PARTITION BY raw_hash, symbol ORDER BY row_id DESC) = 1")
def event_store_dedup(spark: SparkSession, root: str) -> DataFrame:
    return E.last_deliveries(table(spark, root, "stock_event_store"), ["raw_hash", "symbol"], "row_id").select("row_id", "event_id", "symbol")


_FACTORS = """
WITH e AS (SELECT * FROM stock_event_store WHERE symbol IS NOT NULL AND effective_date IS NOT NULL),
sp AS (SELECT symbol, min(effective_date) AS lo, max(effective_date) AS hi FROM e GROUP BY 1),
cal AS (SELECT * FROM (SELECT symbol, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM sp) WHERE isodow(date) < 6),
ef AS (SELECT c.symbol, c.date, count(*) FILTER (WHERE e.effective_date >= c.date - 5) AS event_count_3d, count(*) AS event_count_20d,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive_event_count, count(*) FILTER (WHERE sentiment = 'negative') AS negative_event_count,
  sum(exp(-(c.date - e.effective_date) / 7.0) * coalesce(impact_score, 0)) / sum(exp(-(c.date - e.effective_date) / 7.0)) AS event_impact_score,
  sum(exp(-(c.date - e.effective_date) / 7.0) * coalesce(weighted_impact_score, 0)) / sum(exp(-(c.date - e.effective_date) / 7.0)) AS event_weighted_impact_score,
  sum(exp(-(c.date - e.effective_date) / 7.0) * coalesce(source_reliability, 0)) / sum(exp(-(c.date - e.effective_date) / 7.0)) AS event_reliability_mean,
  sum(exp(-(c.date - e.effective_date) / 7.0) * coalesce(entity_link_confidence, 0)) / sum(exp(-(c.date - e.effective_date) / 7.0)) AS event_link_confidence_mean,
  avg(confidence) AS event_confidence_mean, count(*) FILTER (WHERE sentiment = 'negative' OR event_type LIKE '%risk%') AS event_risk_count, count(*) FILTER (WHERE source_reliability >= 0.8) AS high_reliability_event_count,
  list(event_type ORDER BY published_at DESC NULLS LAST, row_id DESC)[1] AS latest_event_type, list(title ORDER BY published_at DESC NULLS LAST, row_id DESC)[1] AS latest_event_title,
  list(source ORDER BY published_at DESC NULLS LAST, row_id DESC)[1] AS latest_event_source, list(sentiment ORDER BY published_at DESC NULLS LAST, row_id DESC)[1] AS latest_event_sentiment
FROM cal c JOIN e ON e.symbol = c.symbol AND e.effective_date BETWEEN c.date - 30 AND c.date GROUP BY 1, 2)"""


@query(with_final(_FACTORS, "SELECT * FROM ef", "event_impact_score event_weighted_impact_score event_reliability_mean event_link_confidence_mean event_confidence_mean"), dates="date")
def event_factors(spark: SparkSession, root: str) -> DataFrame:
    return tidy(E.event_factors(table(spark, root, "stock_event_store")))


@query(rounded("SELECT u.symbol, count(e.row_id) AS event_count, min(effective_date) AS first_day, max(effective_date) AS last_day, coalesce(string_agg(DISTINCT event_type, ';' ORDER BY event_type), '') AS event_types, count(*) FILTER (WHERE sentiment = 'negative') AS negative_count, count(*) FILTER (WHERE sentiment = 'positive') AS positive_count, count(*) FILTER (WHERE sentiment = 'negative' OR event_type LIKE '%risk%') AS risk_count, CAST(sum(CAST(source_reliability AS DECIMAL(20,10))) AS DOUBLE) / nullif(count(source_reliability), 0) AS mean_reliability FROM (SELECT DISTINCT symbol FROM daily_bar) u LEFT JOIN stock_event_store e USING (symbol) GROUP BY 1", "mean_reliability"), dates="first_day last_day")
def event_coverage(spark: SparkSession, root: str) -> DataFrame:
    return tidy(E.coverage_by_symbol(table(spark, root, "stock_event_store"), table(spark, root, "daily_bar")))


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    return E.event_returns(news(spark, root).select("event_id", "symbol", "effective_date", "event_type", "source"), bars(spark, root), [1, 5, 20])


_RETURNS = f"""WITH {BARS_SQL}, {NEWS_SQL},
lab AS (SELECT symbol, date, h AS horizon_days, CASE h WHEN 1 THEN c1 WHEN 5 THEN c5 ELSE c20 END / close - 1 AS forward_return, CASE h WHEN 1 THEN d1 WHEN 5 THEN d5 ELSE d20 END AS known_at
  FROM (SELECT *, {', '.join(f'lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) AS c{h}, lead(date, {h}) OVER (PARTITION BY symbol ORDER BY date) AS d{h}' for h in (1, 5, 20))} FROM bars), (SELECT unnest([1, 5, 20]) AS h)),
labx AS (SELECT *, forward_return - avg(forward_return) OVER (PARTITION BY date, horizon_days) AS excess_return FROM lab),
placed AS (SELECT n.event_id, n.symbol, n.effective_date, n.event_type, n.source, b.date AS trade_date FROM news n ASOF LEFT JOIN bars b ON n.symbol = b.symbol AND n.effective_date <= b.date),
ret AS (SELECT p.symbol, p.trade_date, h.h AS horizon_days, p.event_id, p.effective_date, p.event_type, p.source, l.forward_return, l.known_at, l.excess_return
  FROM placed p CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) h LEFT JOIN labx l ON l.symbol = p.symbol AND l.date = p.trade_date AND l.horizon_days = h.h)"""


@query(with_final(_RETURNS, "SELECT * FROM ret", "forward_return excess_return"), dates="trade_date effective_date known_at")
def event_impact_returns(spark: SparkSession, root: str) -> DataFrame:
    return tidy(outcomes(spark, root))


#: name -> columns of the groupings of the event study.
COHORTS = {"event_type": ["event_type"], "sentiment": ["sentiment"], "event_type_sentiment": ["event_type", "sentiment"], "event_type_reliability": ["event_type", "reliability"], "source_category": ["source_category"]}
_LEVELS = [COHORTS[n] for n in COHORTS]


def store_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Every stored event with its returns over 1, 5 and 20 clean bars of daily_bar."""
    level = F.when(F.col("source_reliability") >= 0.8, "high").when(F.col("source_reliability") >= 0.5, "medium").when(F.col("source_reliability").isNotNull(), "low")
    stored = table(spark, root, "stock_event_store").select("row_id", "symbol", "effective_date", "event_type", "sentiment", "source_category", level.alias("reliability"), "source_reliability", "entity_link_confidence")
    return E.event_returns(stored, normalize_bars(table(spark, root, "daily_bar"), "row_id"), [1, 5, 20])


_STORE_RETURNS = """WITH bars AS (SELECT date, lpad(right(symbol, 6), 6, '0') AS symbol, close FROM daily_bar WHERE date IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND amount > 0 AND NOT isnan(close)
  QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY row_id DESC) = 1),
lab AS (SELECT symbol, date, unnest([1, 5, 20]) AS horizon_days, unnest([c1, c5, c20]) / close - 1 AS forward_return FROM (SELECT *, """ + ", ".join(f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) AS c{h}" for h in (1, 5, 20)) + """ FROM bars)),
labx AS (SELECT *, forward_return - avg(forward_return) OVER (PARTITION BY date, horizon_days) AS excess_return FROM lab),
ev AS (SELECT *, CASE WHEN source_reliability >= 0.8 THEN 'high' WHEN source_reliability >= 0.5 THEN 'medium' WHEN source_reliability IS NOT NULL THEN 'low' END AS reliability FROM stock_event_store WHERE effective_date IS NOT NULL),
placed AS (SELECT e.*, b.date AS trade_date FROM ev e ASOF JOIN bars b ON e.symbol = b.symbol AND e.effective_date <= b.date),
ret AS (SELECT p.*, l.horizon_days, l.forward_return, l.excess_return FROM placed p JOIN labx l ON l.symbol = p.symbol AND l.date = p.trade_date WHERE l.forward_return IS NOT NULL)"""
_STATS = "count(*) AS sample_count, avg(forward_return) AS mean_return, quantile_cont(forward_return, 0.5) AS median_return, avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, coalesce(avg(excess_return), 0) AS mean_excess_return, coalesce(stddev_samp(forward_return), 0) AS return_std, CASE WHEN count(*) > 1 AND stddev_samp(forward_return) > 0 THEN avg(forward_return) / (stddev_samp(forward_return) / sqrt(count(*))) ELSE 0 END AS t_stat, avg(coalesce(source_reliability, 0)) AS mean_source_reliability, avg(coalesce(entity_link_confidence, 0)) AS mean_entity_link_confidence"


def _shown(level: list[str]) -> str:
    return " || '|' || ".join(f"coalesce({x}, '(null)')" for x in level)


@query(with_final(_STORE_RETURNS, " UNION ALL ".join(f"SELECT '{'_'.join(level)}' AS cohort_level, {_shown(level)} AS cohort_key, horizon_days, {_STATS} FROM ret GROUP BY {', '.join(level)}, horizon_days" for level in _LEVELS), "mean_return median_return positive_rate mean_excess_return return_std t_stat mean_source_reliability mean_entity_link_confidence", 5))
def event_cohorts(spark: SparkSession, root: str) -> DataFrame:
    """Five groupings of the stored events, nulls in them included."""
    return tidy(E.event_cohorts(store_outcomes(spark, root), _LEVELS, ["source_reliability", "entity_link_confidence"]), 5)


@query(with_final(_STORE_RETURNS, "SELECT horizon_days, count(DISTINCT row_id) AS events, count(DISTINCT symbol) AS symbols, avg(forward_return) AS mean_return, avg(excess_return) AS mean_excess_return, avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, min(effective_date) AS first_day, max(effective_date) AS last_day FROM ret GROUP BY 1", "mean_return mean_excess_return positive_rate"), dates="first_day last_day")
def event_study_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per horizon: events and symbols with a return, mean returns and share of gains, and the span of days."""
    return tidy(E.study_summary(store_outcomes(spark, root), "row_id"))


@query(with_final(_RETURNS + """,
kd AS (SELECT event_type, source, horizon_days, known_at, count(*) AS n, sum(forward_return) AS s, count(*) FILTER (WHERE forward_return > 0) AS p FROM ret WHERE forward_return IS NOT NULL GROUP BY 1, 2, 3, 4),
cu AS (SELECT event_type, source, horizon_days, known_at, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(p) OVER w AS p FROM kd WINDOW w AS (PARTITION BY event_type, source, horizon_days ORDER BY known_at)),
pr AS (SELECT r.event_id, r.event_type, r.source, r.horizon_days, CAST(coalesce(n, 0) AS BIGINT) AS prior_count, coalesce(s / n, 0) AS prior_mean_return, coalesce(p / n, 0) AS prior_positive_rate FROM ret r ASOF LEFT JOIN cu c ON c.event_type = r.event_type AND c.source = r.source AND c.horizon_days = r.horizon_days AND c.known_at < r.effective_date)""", "SELECT * FROM pr", "prior_mean_return prior_positive_rate"))
def event_pit_priors(spark: SparkSession, root: str) -> DataFrame:
    return tidy(E.prior_outcomes(outcomes(spark, root), ["event_type", "source"], ["event_id"]))


@query(f"WITH {BARS_SQL}, {NEWS_SQL}, nd AS (SELECT symbol, effective_date AS row_date, arg_max(event_type, event_id) AS event_type FROM news GROUP BY 1, 2) SELECT b.symbol, strftime(b.date, '%Y-%m-%d') AS date, CASE WHEN n.row_date >= b.date - 30 THEN strftime(n.row_date, '%Y-%m-%d') END AS event_date, CASE WHEN n.row_date >= b.date - 30 THEN n.event_type END AS event_type FROM bars b ASOF LEFT JOIN nd n ON n.symbol = b.symbol AND n.row_date <= b.date")
def latest_event_within_30d(spark: SparkSession, root: str) -> DataFrame:
    daily = news(spark, root).groupBy("symbol", F.col("effective_date").alias("date")).agg(F.max_by("event_type", "event_id").alias("event_type"))
    return tidy(E.latest_within(bars(spark, root).select("symbol", "date"), daily, 30, ["event_type"]))


_HELD = _TARGETS + f""", {NEWS_SQL}, nf AS (SELECT symbol, effective_date AS date, count(*) AS n, count(*) FILTER (WHERE impact_score > 0) AS pos, count(*) FILTER (WHERE impact_score < 0) AS neg, count(*) FILTER (WHERE event_type = 'regulatory_inquiry') AS risk, avg(impact_score) AS i FROM news GROUP BY 1, 2),
hv AS (SELECT t.date, t.symbol, t.weight, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(risk, 0) AS risk, coalesce(i, 0) AS i FROM tg t LEFT JOIN nf ON nf.date = t.date AND nf.symbol = t.symbol)"""


def news_factors(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("impact_score")
    return news(spark, root).groupBy("symbol", F.col("effective_date").alias("date")).agg(
        F.count(F.lit(1)).alias("event_count_20d"), F.count_if(x > 0).alias("positive_event_count"), F.count_if(x < 0).alias("negative_event_count"), F.count_if(F.col("event_type") == "regulatory_inquiry").alias("event_risk_count"),
        F.avg(x).alias("event_impact_score"), F.lit(None).cast("double").alias("event_weighted_impact_score"), F.avg("confidence").alias("event_confidence_mean"),
    )


@query(with_final(_HELD, "SELECT date, count(DISTINCT symbol) AS holding_count, sum(weight) AS gross_weight, sum(CASE WHEN n > 0 THEN weight ELSE 0 END) AS event_exposed_weight, sum(CASE WHEN risk > 0 THEN weight ELSE 0 END) AS risk_event_weight, sum(weight * i) AS weighted_event_impact, sum(weight * pos) AS weighted_positive_events, sum(weight * neg) AS weighted_negative_events, sum(weight * risk) AS weighted_risk_events FROM hv GROUP BY 1", "gross_weight event_exposed_weight risk_event_weight weighted_event_impact weighted_positive_events weighted_negative_events weighted_risk_events"), dates="date")
def event_attribution(spark: SparkSession, root: str) -> DataFrame:
    return tidy(E.exposure(targets(spark, root), news_factors(spark, root)))


@query(with_final(_HELD, "SELECT symbol, count(DISTINCT date) AS days_held, avg(weight) AS avg_weight, max(weight) AS max_weight, count(*) FILTER (WHERE n > 0) AS event_exposed_days, count(*) FILTER (WHERE risk > 0) AS risk_event_days, avg(i) AS avg_event_impact, sum(weight * i) AS weighted_event_impact, sum(weight * risk) AS weighted_risk_events FROM hv GROUP BY 1", "avg_weight max_weight avg_event_impact weighted_event_impact weighted_risk_events"))
def event_attribution_symbol(spark: SparkSession, root: str) -> DataFrame:
    return tidy(E.exposure_by_symbol(targets(spark, root), news_factors(spark, root)))


@query(with_final(f"WITH {BARS_SQL}, m AS (SELECT symbol, date, close / {lag('close')} - 1 AS r1, close / {lag('close', 5)} - 1 AS r5 FROM bars)", "SELECT symbol, date, r1, r5, greatest(-0.85, least(0.85, 8 * CASE WHEN abs(r1) >= coalesce(abs(r5), 0) THEN r1 ELSE r5 END)) AS impact FROM m WHERE abs(r1) >= 0.0555 OR abs(r5) >= 0.0999", "r1 r5 impact"), dates="date")
def price_shocks(spark: SparkSession, root: str) -> DataFrame:
    return tidy(E.price_shocks(bars(spark, root), 0.0555))


@query()
def similar_events(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar earlier events, of all symbols, of the five latest events of each symbol."""
    return tidy(E.similar_earlier(table(spark, root, "stock_event_store")))
