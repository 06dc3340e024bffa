"""Queries on dense panels, paths, expanding estimates and mentions, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.rolling import rank_share
from barloom.operators import links as L
from barloom.operators import panels as N
from barloom.plans.evaluation import scored
from barloom.plans.research import _SCORE, rounded, sql_rank, tidy, with_final
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, bars


def dense_prices(spark: SparkSession, root: str) -> DataFrame:
    """The last known close of every symbol on every trading date of its span."""
    return tidy(N.dense_prices(bars(spark, root)))


DENSE = "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM (" + with_final(
    f"WITH {BARS_SQL}, sp AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1), dd AS (SELECT DISTINCT date FROM bars)",
    "SELECT s.symbol, d.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY d.date) AS close, b.close IS NULL AS filled FROM sp s JOIN dd d ON d.date BETWEEN s.lo AND s.hi LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date",
    "close",
) + ")"


def forecast_paths(spark: SparkSession, root: str) -> DataFrame:
    """Expected returns of each symbol for 1 to 20 days ahead, between its forecast horizons."""
    mean = F.avg(F.col("expected_return").cast("decimal(20,10)")).cast("double").alias("expected_return")
    anchors = table(spark, root, "stock_forecast").groupBy("symbol", "horizon_days").agg(mean)
    return tidy(N.interpolated(anchors, ["symbol"], "horizon_days", "expected_return", 20))


PATHS = rounded("""
WITH a AS (SELECT symbol, horizon_days AS h, CAST(sum(CAST(expected_return AS DECIMAL(20,10))) AS DOUBLE) / count(expected_return) AS v FROM stock_forecast WHERE horizon_days IS NOT NULL GROUP BY 1, 2 HAVING count(expected_return) > 0),
s AS (SELECT DISTINCT symbol FROM a), p AS (SELECT symbol, CAST(unnest(generate_series(1, 20)) AS INTEGER) AS step FROM s),
j AS (SELECT p.symbol, p.step, max(h) FILTER (WHERE h <= step) AS lo, min(h) FILTER (WHERE h >= step) AS hi, arg_max(v, h) FILTER (WHERE h <= step) AS lv, arg_min(v, h) FILTER (WHERE h >= step) AS hv FROM p JOIN a USING (symbol) GROUP BY 1, 2)
SELECT symbol, step, coalesce(CASE WHEN hi = lo THEN lv ELSE lv + (hv - lv) * (step - lo) / (hi - lo) END, lv, hv) AS expected_return FROM j""", "expected_return")


def expanding_probability(spark: SparkSession, root: str) -> DataFrame:
    """The line of direction on the score's daily rank share, from strictly earlier dates."""
    rows = scored(spark, root).select("date", rank_share(F.col("score"), "date").alias("x"), F.col("direction").alias("y"))
    return tidy(N.expanding_line(rows))


EXPANDING = "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM (" + with_final(
    _SCORE + f""", x0 AS (SELECT s.date, round(s.score, 9) AS score, CASE WHEN p.label > 0 THEN 1.0 WHEN p.label IS NOT NULL THEN 0.0 END AS y FROM sc s JOIN panel p ON p.date = s.date AND p.symbol = s.symbol),
x1 AS (SELECT date, {sql_rank('score', 'date')} / count(*) OVER (PARTITION BY date) AS x, CAST(y AS DOUBLE) AS y FROM x0), xd AS (SELECT DISTINCT date FROM x1),
xc AS (SELECT d.date, count(*) AS n, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my FROM xd d JOIN x1 ON x1.date < d.date AND y IS NOT NULL GROUP BY 1)""",
    "SELECT date, n AS known_rows, my - b * mx AS alpha, b AS beta FROM xc WHERE n >= 80",
    "alpha beta",
) + ")"


def mentioned_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of the bar table whose codes stand in event titles."""
    return N.mentioned_symbols(table(spark, root, "stock_event_store"), "row_id", "title", table(spark, root, "daily_bar"))


MENTIONED = "SELECT DISTINCT row_id, c AS symbol FROM (SELECT row_id, unnest(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 6)) AS c FROM stock_event_store) WHERE c IN (SELECT symbol FROM daily_bar)"

def row_probabilities(spark: SparkSession, root: str) -> DataFrame:
    """Each score's probability of a rise, from the line of strictly earlier dates."""
    rows = scored(spark, root).select("date", "symbol", rank_share(F.col("score"), "date").alias("x"), F.col("direction").alias("y"))
    return tidy(N.line_probabilities(rows, N.expanding_line(rows)).select("date", "symbol", "prob_up"), 5)


ROW_PROBABILITIES = "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM (" + with_final(
    _SCORE + f""", x0 AS (SELECT s.date, s.symbol, round(s.score, 9) AS score, CASE WHEN p.label > 0 THEN 1.0 WHEN p.label IS NOT NULL THEN 0.0 END AS y FROM sc s JOIN panel p ON p.date = s.date AND p.symbol = s.symbol),
x1 AS (SELECT date, symbol, {sql_rank('score', 'date')} / count(*) OVER (PARTITION BY date) AS x, CAST(y AS DOUBLE) AS y FROM x0), xd AS (SELECT DISTINCT date FROM x1),
xc AS (SELECT d.date, count(x1.y) AS n, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my FROM xd d LEFT JOIN x1 ON x1.date < d.date AND y IS NOT NULL GROUP BY 1)""",
    "SELECT x1.date, x1.symbol, CASE WHEN n >= 80 AND b IS NOT NULL THEN greatest(0.05, least(0.95, my - b * mx + b * x1.x)) ELSE coalesce(my, 0.5) END AS prob_up FROM x1 JOIN xc ON xc.date = x1.date",
    "prob_up", 5,
) + ")"


def _names(spark: SparkSession, root: str) -> DataFrame:
    pattern = r"^([A-Z][a-z]+ [A-Z][a-z]+) \(([0-9]{6})\)"
    title = F.col("title")
    named = table(spark, root, "stock_event_store").select(F.regexp_extract(title, pattern, 2).alias("symbol"), F.regexp_extract(title, pattern, 1).alias("name")).where("symbol <> ''")
    return table(spark, root, "daily_bar").select("symbol").distinct().join(named.groupBy("symbol").agg(F.min("name").alias("name")), "symbol", "left")


def linked_events(spark: SparkSession, root: str) -> DataFrame:
    """Events and the symbols they are about, by code, list and name, else by keyword, each by its surest route."""
    store = table(spark, root, "stock_event_store")
    words = store.where(~F.col("entity_link_keywords").rlike("^[0-9;]*$")).groupBy(F.col("entity_link_keywords").alias("keyword")).agg(F.min("symbol").alias("symbol"))
    texts = store.select(F.col("row_id").alias("id"), F.concat_ws(" ", "title", "summary").alias("text"), F.when(F.col("row_id") % 3 == 0, F.col("symbol")).alias("symbol"), F.when(F.col("row_id") % 3 == 1, F.regexp_extract_all("related_symbols", F.lit("[0-9]{6}"), F.lit(0))).alias("related"))
    return tidy(L.linked_symbols(texts, _names(spark, root), words).withColumnRenamed("id", "row_id"))


LINKED = rounded(r"""WITH sy AS (SELECT DISTINCT symbol FROM daily_bar),
nm AS (SELECT symbol, min(lower(name)) AS name FROM (SELECT regexp_extract(title, '^([A-Z][a-z]+ [A-Z][a-z]+) \(([0-9]{6})\)', 1) AS name, regexp_extract(title, '^([A-Z][a-z]+ [A-Z][a-z]+) \(([0-9]{6})\)', 2) AS symbol FROM stock_event_store) WHERE symbol IN (SELECT symbol FROM sy) AND length(name) >= 3 GROUP BY 1),
kw AS (SELECT lower(entity_link_keywords) AS w, min(symbol) AS symbol FROM stock_event_store WHERE entity_link_keywords IS NOT NULL AND NOT regexp_matches(entity_link_keywords, '^[0-9;]*$') GROUP BY entity_link_keywords),
tx AS (SELECT row_id, concat_ws(' ', title, summary) AS t, CASE WHEN row_id % 3 = 0 THEN symbol END AS s, CASE WHEN row_id % 3 = 1 THEN regexp_extract_all(related_symbols, '[0-9]{6}') END AS r FROM stock_event_store),
di AS (SELECT row_id, s AS symbol, 0 AS o, s AS k FROM tx WHERE s IN (SELECT symbol FROM sy) UNION ALL SELECT * FROM (SELECT row_id, unnest(r) AS symbol, 1, unnest(r) FROM tx) WHERE symbol IN (SELECT symbol FROM sy)
  UNION ALL SELECT * FROM (SELECT row_id, unnest(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x) = 6)) AS symbol, 2, unnest(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x) = 6)) FROM tx) WHERE symbol IN (SELECT symbol FROM sy)
  UNION ALL SELECT row_id, symbol, 3, name FROM tx JOIN nm ON contains(lower(t), name)),
be AS (SELECT row_id, symbol, min(o) AS o, arg_min(k, o) AS k FROM di GROUP BY 1, 2),
th AS (SELECT row_id, symbol, count(DISTINCT w) AS n, string_agg(DISTINCT w, ',' ORDER BY w) AS k FROM tx JOIN (SELECT DISTINCT w, symbol FROM kw WHERE symbol IN (SELECT symbol FROM sy)) z ON contains(lower(t), w) WHERE row_id NOT IN (SELECT row_id FROM be) GROUP BY 1, 2)
SELECT row_id, symbol, CASE o WHEN 0 THEN 'explicit_symbol' WHEN 1 THEN 'provided_related_symbols' WHEN 2 THEN 'code_mention' ELSE 'name_mention' END AS method, CASE o WHEN 0 THEN 1.0 WHEN 3 THEN 0.85 ELSE 0.95 END AS confidence, k AS keywords FROM be
UNION ALL SELECT row_id, symbol, 'theme_keyword', least(0.78, 0.5 + 0.07 * n), k FROM th""", "confidence")


def part_symbols(spark: SparkSession, root: str) -> DataFrame:
    """For each kind of part those in whose name it stands, as a commodity and the symbols it moves."""
    kinds = spark.createDataFrame([(m.lower(), m) for m in ("RING", "WIDGET", "BOLT", "GEAR")], "series string, keyword string")
    part = table(spark, root, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_name").alias("theme"))
    return L.keyword_symbols(kinds, part)


PARTS = "SELECT lower(m) AS series, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ';' ORDER BY CAST(p_partkey AS VARCHAR)) AS symbols FROM (SELECT unnest(['RING', 'WIDGET', 'BOLT', 'GEAR']) AS m) JOIN part ON contains(lower(p_name), lower(m)) GROUP BY 1"
QUERIES = {f.__name__: f for f in (dense_prices, forecast_paths, expanding_probability, mentioned_symbols, row_probabilities, linked_events, part_symbols)}
SQL = {"dense_prices": DENSE, "forecast_paths": PATHS, "expanding_probability": EXPANDING, "mentioned_symbols": MENTIONED, "row_probabilities": ROW_PROBABILITIES, "linked_events": LINKED, "part_symbols": PARTS}
