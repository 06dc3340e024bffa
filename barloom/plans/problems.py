"""Queries p1, p2, p3 and p5 over the test tables, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.asof import attributes_as_of
from barloom.operators.packed import split_packed
from barloom.operators.tablediff import diff_tables
from barloom.operators.trailing import entity_calendar, trailing_totals
from barloom.sources import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    factors, events = table(spark, root, "stock_event_factors"), table(spark, root, "stock_event_store")
    true = trailing_totals(
        factors,
        events,
        measures={"n": F.lit(1), "negative": F.when(F.col("sentiment") == "negative", 1).otherwise(0)},
        periods={"5": 5, "30": 30},
    )
    stored = factors.select("row_id", F.col("symbol").alias("entity"), F.col("date").alias("day"), "event_count_3d", "event_count_20d", "negative_event_count")
    both = stored.join(true, ["entity", "day"], "left")
    wrong = F.lit(False)
    for have, want in (("event_count_3d", "n_5"), ("event_count_20d", "n_30"), ("negative_event_count", "negative_30")):
        wrong = wrong | F.col(have).isNull() | (F.col(have) != F.coalesce(want, F.lit(0)))
    return both.where(wrong).select(F.col("row_id").alias("factor_row_id"))


P1_FOUND = """
WITH daily AS (
  SELECT symbol, effective_date AS d, count(*) AS n, count(*) FILTER (WHERE sentiment = 'negative') AS neg
  FROM stock_event_store WHERE effective_date IS NOT NULL GROUP BY 1, 2),
truth AS (
  SELECT f.symbol, f.date, sum(CASE WHEN e.d >= f.date - 5 THEN e.n ELSE 0 END) AS c3, sum(e.n) AS c20, sum(e.neg) AS neg
  FROM (SELECT DISTINCT symbol, date FROM stock_event_factors) f JOIN daily e ON e.symbol = f.symbol AND e.d BETWEEN f.date - 30 AND f.date
  GROUP BY 1, 2)
SELECT f.row_id AS factor_row_id
FROM stock_event_factors f LEFT JOIN truth t ON t.symbol = f.symbol AND t.date = f.date
WHERE f.event_count_3d IS NULL OR f.event_count_20d IS NULL OR f.negative_event_count IS NULL
   OR f.event_count_3d <> coalesce(t.c3, 0) OR f.event_count_20d <> coalesce(t.c20, 0) OR f.negative_event_count <> coalesce(t.neg, 0)
"""


def p1_trailing_week_month(spark: SparkSession, root: str) -> DataFrame:
    """Totals and mean impact of the last 7 and 30 days for every symbol and calendar day of its span."""
    events = table(spark, root, "stock_event_store")
    got = trailing_totals(
        entity_calendar(events, "symbol", "effective_date"),
        events,
        entity="entity",
        calendar_day="day",
        event_entity="symbol",
        measures={"events": F.lit(1), "negative": F.when(F.col("sentiment") == "negative", 1).otherwise(0), "impact": F.col("impact_score").cast("decimal(20,10)")},
        periods={"7d": 6, "30d": 29},
        means=("impact",),
    )
    names = ["events_7d", "negative_7d", "events_30d", "negative_30d"]
    means = [F.round(c, 6).alias(c) for c in ("impact_mean_7d", "impact_mean_30d")]
    return got.select(F.col("entity").alias("symbol"), F.col("day").cast("string").alias("day"), *[F.col(c).cast("long").alias(c) for c in names], *means)


P1_TRAILING = """
WITH daily AS (
  SELECT symbol, effective_date AS d, count(*) AS n, count(*) FILTER (WHERE sentiment = 'negative') AS neg,
         sum(CAST(impact_score AS DECIMAL(20,10))) AS s, count(impact_score) AS c
  FROM stock_event_store WHERE effective_date IS NOT NULL AND symbol IS NOT NULL GROUP BY 1, 2),
span AS (SELECT symbol, min(d) AS lo, max(d) AS hi FROM daily GROUP BY 1),
cal AS (SELECT symbol, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT c.symbol, CAST(c.day AS VARCHAR) AS day,
       CAST(coalesce(sum(e.n) FILTER (WHERE e.d >= c.day - 6), 0) AS BIGINT) AS events_7d,
       CAST(coalesce(sum(e.neg) FILTER (WHERE e.d >= c.day - 6), 0) AS BIGINT) AS negative_7d,
       CAST(coalesce(sum(e.n), 0) AS BIGINT) AS events_30d, CAST(coalesce(sum(e.neg), 0) AS BIGINT) AS negative_30d,
       round(CAST(sum(e.s) FILTER (WHERE e.d >= c.day - 6) AS DOUBLE) / nullif(CAST(sum(e.c) FILTER (WHERE e.d >= c.day - 6) AS DOUBLE), 0), 6) AS impact_mean_7d,
       round(CAST(sum(e.s) AS DOUBLE) / nullif(CAST(sum(e.c) AS DOUBLE), 0), 6) AS impact_mean_30d
FROM cal c LEFT JOIN daily e ON e.symbol = c.symbol AND e.d BETWEEN c.day - 29 AND c.day
GROUP BY 1, 2
"""


def _bar_diff(spark: SparkSession, root: str) -> DataFrame:
    return diff_tables(
        table(spark, root, "daily_bar"),
        table(spark, root, "daily_bar_mirror"),
        entity="symbol",
        order="date",
        version="fetched_at",
        fields=["close", "amount", "volume"],
        missing_right="missing_in_mirror",
        missing_left="missing_in_daily_bar",
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _bar_diff(spark, root).select(F.col("entity").alias("symbol"), F.date_format("day", "yyyy-MM-dd").alias("bar_date"), "issue")


def p2_values(spark: SparkSession, root: str) -> DataFrame:
    """The differing values themselves."""
    return _bar_diff(spark, root).select(F.col("entity").alias("symbol"), F.date_format("day", "yyyy-MM-dd").alias("bar_date"), "issue", "left_value", "right_value")


_P2 = """
WITH a AS (SELECT symbol, date, {nan} FROM daily_bar WHERE symbol IS NOT NULL AND date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fetched_at DESC NULLS LAST, row_id) = 1),
b AS (SELECT symbol, date, {nan} FROM daily_bar_mirror WHERE symbol IS NOT NULL AND date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fetched_at DESC NULLS LAST, row_id) = 1),
j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, strftime(coalesce(a.date, b.date), '%Y-%m-%d') AS bar_date, a.symbol IS NOT NULL AS l, b.symbol IS NOT NULL AS r,
             a.close AS c1, b.close AS c2, a.amount AS a1, b.amount AS a2, a.volume AS v1, b.volume AS v2
      FROM a FULL OUTER JOIN b ON a.symbol = b.symbol AND a.date = b.date)
""".format(nan=", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("close", "amount", "volume")))

P2_VALUES = _P2 + "\nUNION ALL\n".join(
    ["SELECT symbol, bar_date, 'missing_in_mirror' AS issue, CAST(NULL AS DOUBLE) AS left_value, CAST(NULL AS DOUBLE) AS right_value FROM j WHERE l AND NOT r", "SELECT symbol, bar_date, 'missing_in_daily_bar', NULL, NULL FROM j WHERE r AND NOT l"]
    + [f"SELECT symbol, bar_date, '{name}', {c}1, {c}2 FROM j WHERE l AND r AND coalesce(abs({c}1 - {c}2) > 0.001, ({c}1 IS NULL) <> ({c}2 IS NULL))" for name, c in (("close", "c"), ("amount", "a"), ("volume", "v"))]
)
P2_FOUND = f"SELECT symbol, bar_date, issue FROM ({P2_VALUES})"


def _packed_sources(spark: SparkSession, root: str) -> list:
    return [
        ("stock_event_store", table(spark, root, "stock_event_store"), "row_id", ["related_symbols"]),
        ("stock_forecast", table(spark, root, "stock_forecast"), "row_id", ["risk_flags", "top_factor_contributors"]),
        ("evaluation_by_size", table(spark, root, "evaluation_by_size"), "row_id", ["probability_calibration_statuses"]),
    ]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return split_packed(_packed_sources(spark, root))


_VALUE = r"""'"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[\p{L}\p{N}_:=.+\-%]+'"""
P3_FOUND = f"""
WITH f AS (
  SELECT 'stock_event_store' AS table_name, row_id, 'related_symbols' AS field_name, related_symbols AS s FROM stock_event_store
  UNION ALL SELECT 'stock_forecast', row_id, 'risk_flags', risk_flags FROM stock_forecast
  UNION ALL SELECT 'stock_forecast', row_id, 'top_factor_contributors', top_factor_contributors FROM stock_forecast
  UNION ALL SELECT 'evaluation_by_size', row_id, 'probability_calibration_statuses', probability_calibration_statuses FROM evaluation_by_size),
v AS (SELECT *, list_filter(regexp_extract_all(s, {_VALUE}), lambda x: x NOT IN ('""', '''''')) AS raw FROM f WHERE s IS NOT NULL),
u AS (SELECT table_name, row_id, field_name, unnest(raw) AS r, generate_subscripts(raw, 1) AS pos FROM v)
SELECT table_name, row_id, field_name, CAST(pos AS INTEGER) AS pos,
       CASE WHEN r[1] = '"' THEN replace(r[2:length(r) - 1], '""', '"') WHEN r[1] = '''' THEN replace(r[2:length(r) - 1], '''''', '''') ELSE r END AS item
FROM u
"""


def _as_of(spark: SparkSession, root: str, attributes: list[str]) -> DataFrame:
    return attributes_as_of(
        table(spark, root, "stock_event_store"),
        table(spark, root, "stock_event_factors"),
        event_id="row_id",
        event_entity="symbol",
        event_time="published_at",
        event_day="effective_date",
        version_id="row_id",
        version_entity="symbol",
        version_day="date",
        version_time="fetched_at",
        attributes=attributes,
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _as_of(spark, root, []).select(F.col("event_id").alias("event_row_id"), F.col("version_id").alias("factor_row_id"))


def p5_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Each event with the impact and counts in force and known when it was published."""
    return _as_of(spark, root, ["event_weighted_impact_score", "event_count_20d", "latest_event_type"]).withColumnsRenamed({"event_id": "event_row_id", "version_id": "factor_row_id"})


_P5 = """
SELECT e.row_id AS event_row_id, f.row_id AS factor_row_id{more}
FROM stock_event_store e JOIN stock_event_factors f ON f.symbol = e.symbol AND f.date <= e.effective_date AND f.fetched_at <= e.published_at
QUALIFY row_number() OVER (PARTITION BY e.row_id ORDER BY f.date DESC, f.fetched_at DESC, f.row_id) = 1
"""
P5_FOUND = _P5.format(more="")
P5_ATTRIBUTES = _P5.format(more=", f.event_weighted_impact_score, f.event_count_20d, f.latest_event_type")

QUERIES = {f.__name__: f for f in (p1_found, p1_trailing_week_month, p2_found, p2_values, p3_found, p5_found, p5_attributes)}
SQL = {"p1_found": P1_FOUND, "p1_trailing_week_month": P1_TRAILING, "p2_found": P2_FOUND, "p2_values": P2_VALUES, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_attributes": P5_ATTRIBUTES}
