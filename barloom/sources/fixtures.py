"""Bars and events derived from the order and event tables, for queries on data without market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.sources.tables import table


def bars(spark: SparkSession, root: str, buckets: int = 0) -> DataFrame:
    """(date, symbol, open, high, low, close, volume, amount, turnover): a supplier's shipments of a day as a daily bar.

    Five narrow columns are shuffled once, by symbol, or by a hash of it that is given as bucket where buckets are asked for.
    """
    by = ["bucket"] if buckets else []
    item = table(spark, root, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_tax", "l_quantity")
    if buckets:
        item = item.withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(buckets)))
    daily = item.repartition(*(by or ["symbol"])).groupBy(*by, "symbol", "date").agg(
        F.round(F.avg("l_discount"), 6).alias("disc"), F.round(F.avg("l_tax"), 6).alias("tax"), F.round(F.avg("l_quantity"), 6).alias("q"), (F.sum("l_quantity") * 100).alias("volume")
    )
    order = W.partitionBy(*by, "symbol").orderBy("date")
    grown = F.exp(F.sum(F.log(1 + (2 * F.col("disc") - 0.1))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    closed = daily.withColumn("close", (8 + F.col("symbol").cast("int") % 120) * grown)
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(order), "close") * (1 + (F.col("tax") - 0.04) / 4))
    return opened.select(
        "date",
        "symbol",
        F.round("open", 6).alias("open"),
        F.round(F.greatest("open", "close") * (1 + 0.001 + F.col("q") / 3000), 6).alias("high"),
        F.round(F.least("open", "close") * (1 - 0.001 - F.col("q") / 3000), 6).alias("low"),
        F.round("close", 6).alias("close"),
        "volume",
        F.round(F.col("volume") * F.col("close"), 4).alias("amount"),
        F.round(0.3 + F.col("q") / 50 * 7.7, 6).alias("turnover"),
        *by,
    )


BARS_SQL = """
d AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(round(avg(l_discount), 6) AS DOUBLE) AS disc, CAST(round(avg(l_tax), 6) AS DOUBLE) AS tax,
         CAST(round(avg(l_quantity), 6) AS DOUBLE) AS q, sum(l_quantity) * 100 AS volume
  FROM lineitem GROUP BY 1, 2),
r0 AS (SELECT *, 2 * disc - 0.1 AS ret FROM d),
c0 AS (SELECT *, (8 + CAST(symbol AS INT) % 120)
        * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close FROM r0),
o0 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) * (1 + (tax - 0.04) / 4) AS open FROM c0),
bars AS (SELECT date, symbol, round(open, 6) AS open, round(greatest(open, close) * (1 + 0.001 + q / 3000), 6) AS high,
       round(least(open, close) * (1 - 0.001 - q / 3000), 6) AS low, round(close, 6) AS close, volume, round(volume * close, 4) AS amount,
       round(0.3 + q / 50 * 7.7, 6) AS turnover FROM o0)"""


def news(spark: SparkSession, root: str) -> DataFrame:
    """(raw_hash, event_id, effective_date, symbol, event_type, impact_score, confidence, source): user events as news on a supplier."""
    bounds = table(spark, root, "lineitem").agg(F.count_distinct("l_suppkey").alias("k"), F.min("l_suppkey").alias("lo"))
    kind = F.col("event_type")
    named = F.when(kind == "error", "regulatory_inquiry").when(kind == "purchase", "order_contract").when(kind == "signup", "buyback_dividend").when(kind == "view", "commodity_shock").otherwise("industry_policy")
    impact = F.when(kind == "error", -0.70).when(kind == "purchase", 0.55).when(kind == "signup", 0.45).when(kind == "view", 0.20).otherwise(0.10)
    five = F.col("event_id") % 5
    source = F.when(five == 0, "cninfo_disclosure").when(five == 1, "eastmoney_stock_news").when(five == 2, "cctv_macro").when(five == 3, "futures_main").otherwise("sample_news")
    return (
        table(spark, root, "events")
        .withColumns({"lo": bounds.select("lo").scalar(), "k": bounds.select("k").scalar()})
        .select(
            F.sha1(F.concat_ws("|", F.col("event_id").cast("string"), kind)).alias("raw_hash"),
            "event_id",
            F.date_add(F.lit("1998-01-01").cast("date"), ((F.col("event_id") * 7919) % 1200).cast("int")).alias("effective_date"),
            F.lpad((F.col("lo") + F.col("user_id") % F.col("k")).cast("string"), 6, "0").alias("symbol"),
            named.alias("event_type"),
            impact.alias("impact_score"),
            ((45 + F.col("event_id") % 50).cast("double") / 100).alias("confidence"),
            source.alias("source"),
        )
    )


NEWS_SQL = """
nk AS (SELECT count(DISTINCT l_suppkey) AS k, min(l_suppkey) AS lo FROM lineitem),
news AS (SELECT sha1(concat_ws('|', CAST(event_id AS VARCHAR), event_type)) AS raw_hash, event_id,
       DATE '1998-01-01' + CAST((event_id * 7919) % 1200 AS INT) AS effective_date,
       lpad(CAST(lo + user_id % k AS VARCHAR), 6, '0') AS symbol,
       CASE event_type WHEN 'error' THEN 'regulatory_inquiry' WHEN 'purchase' THEN 'order_contract' WHEN 'signup' THEN 'buyback_dividend'
            WHEN 'view' THEN 'commodity_shock' ELSE 'industry_policy' END AS event_type,
       CASE event_type WHEN 'error' THEN CAST(-0.70 AS DOUBLE) WHEN 'purchase' THEN 0.55 WHEN 'signup' THEN 0.45 WHEN 'view' THEN 0.20 ELSE 0.10 END AS impact_score,
       CAST(45 + event_id % 50 AS DOUBLE) / 100 AS confidence,
       CASE event_id % 5 WHEN 0 THEN 'cninfo_disclosure' WHEN 1 THEN 'eastmoney_stock_news' WHEN 2 THEN 'cctv_macro' WHEN 3 THEN 'futures_main' ELSE 'sample_news' END AS source
FROM events CROSS JOIN nk)"""
