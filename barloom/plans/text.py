"""Queries on text columns and streams, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.sources import table
from barloom.streaming import events as S


def text_columns(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned and shortened titles, codes and dates found in them, and a hash of the identifying fields."""
    df = table(spark, root, "stock_event_store")
    return df.select(
        "row_id",
        T.shortened(F.col("title"), 24).alias("short_title"),
        F.array_join(T.codes_in(F.col("title")), ";").alias("codes"),
        T.symbol_code(F.col("symbol")).alias("code"),
        T.keyword_hits(F.col("title"), ["outage", "buyback", "claim", "股息", "回购"]).alias("hits"),
        T.event_key(F.col("source"), F.col("symbol"), F.col("title"), F.col("source_url")).alias("key"),
    )


TEXT_COLUMNS = r"""
WITH s AS (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t FROM stock_event_store)
SELECT row_id, CASE WHEN length(t) > 24 THEN t[1:21] || '...' ELSE t END AS short_title,
  coalesce(array_to_string(list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 6), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ';'), '') AS codes,
  CASE WHEN regexp_replace(symbol, '[^0-9]', '', 'g') <> '' THEN lpad(right(regexp_replace(symbol, '[^0-9]', '', 'g'), 6), 6, '0') END AS code,
  CAST(contains(lower(title), 'outage') AS INT) + CAST(contains(lower(title), 'buyback') AS INT) + CAST(contains(lower(title), 'claim') AS INT) + CAST(contains(lower(title), '股息') AS INT) + CAST(contains(lower(title), '回购') AS INT) AS hits,
  sha1(coalesce(source, '') || '|' || coalesce(symbol, '') || '|' || coalesce(title, '') || '|' || coalesce(source_url, '')) AS key
FROM s
"""


def _stream(spark: SparkSession, root: str) -> DataFrame:
    schema = table(spark, root, "events").schema
    # A pattern, as a stream's plain path must be a folder.
    return S.event_stream(spark, f"{root}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events per type and six hours, from a stream over the table."""
    counts = S.drained(S.windowed_counts(_stream(spark, root), time="ts", key="event_type", size="6 hours"), "complete")
    return counts.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "events")


STREAM_HOURLY = "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, count(*) AS events FROM events GROUP BY 1, 2"


def stream_first_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """The keys of all deliveries within the time a repeat may still arrive, here the span of the table, each once."""
    return S.drained(S.first_deliveries(_stream(spark, root).select("ts", "user_id", "event_type"), time="ts", key=["user_id", "event_type"], late="3650 days"))


def stream_errors_after_signup(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a signup and an error of the same user within a day after it, from two streams."""
    stream = _stream(spark, root)
    pairs = S.drained(S.matched_within(stream.where("event_type = 'signup'"), stream.where("event_type = 'error'"), key="user_id", time="ts", span="1 DAY", late="3650 days"))
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return pairs.select("user_id", shown("left_time"), shown("right_time"))


STREAM_FIRST = "SELECT DISTINCT user_id, event_type FROM events"
STREAM_PAIRS = "SELECT a.user_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS left_time, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS right_time FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'error' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY"
QUERIES = {f.__name__: f for f in (text_columns, stream_hourly_counts, stream_first_deliveries, stream_errors_after_signup)}
SQL = {"text_columns": TEXT_COLUMNS, "stream_hourly_counts": STREAM_HOURLY, "stream_first_deliveries": STREAM_FIRST, "stream_errors_after_signup": STREAM_PAIRS}
