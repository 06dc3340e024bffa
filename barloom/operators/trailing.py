"""Totals and means over trailing calendar periods, days without activity included."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def entity_calendar(events: DataFrame, entity: str, day: str, extend_days: int = 0) -> DataFrame:
    """(entity, day) for every calendar day from an entity's first event day to its last, plus extend_days.

    Rows with a null entity or day give no calendar. One row per entity and day of its span, however skewed the events.
    """
    known = events.select(F.col(entity).alias("entity"), F.col(day).cast("date").alias("day")).where("entity IS NOT NULL AND day IS NOT NULL")
    spans = known.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return spans.select("entity", F.explode(F.sequence("lo", F.date_add("hi", extend_days))).alias("day"))


def trailing_totals(
    calendar: DataFrame,
    events: DataFrame,
    *,
    entity: str = "symbol",
    calendar_day: str = "date",
    event_entity: str | None = None,
    event_day: str = "effective_date",
    measures: Mapping[str, Column],
    periods: Mapping[str, int],
    means: tuple[str, ...] = (),
) -> DataFrame:
    """For each distinct (entity, day) of calendar, totals of each measure over the days [day - periods[p], day].

    Result columns: entity, day, <measure>_<period> and, for the measures named in means, <measure>_mean_<period>:
    the total divided by the number of events whose measure is not null (null without any).

    Events are first summed to one row per entity and day, with map-side combining, so copies and hot entities shrink
    before any shuffle. Days fall into buckets as wide as the longest period; a daily total is offered to its own bucket
    and the next, so a calendar day meets at most two buckets of totals of its entity: a bounded equi-join with a range
    condition. The aggregation reuses the join's partitioning by (entity, bucket).

    Null entity or day in either input: no row from there. No events in a period: totals 0, means null. Empty events:
    all totals 0. Repeated calendar rows: one result row. Other columns of the inputs are never read, whatever their names.
    """
    longest = max(periods.values())
    width = longest + 1
    cal = (
        calendar.select(F.col(entity).alias("entity"), F.col(calendar_day).cast("date").alias("day"))
        .where("entity IS NOT NULL AND day IS NOT NULL")
        .distinct()
        .withColumn("bucket", F.floor(day_number(F.col("day")) / width).cast("int"))
    )
    columns = [expression.alias(f"m_{name}") for name, expression in measures.items()]
    daily = (
        events.select(F.col(event_entity or entity).alias("entity"), F.col(event_day).cast("date").alias("event_day"), *columns)
        .where("entity IS NOT NULL AND event_day IS NOT NULL")
        .groupBy("entity", "event_day")
        .agg(*[F.sum(f"m_{m}").alias(f"s_{m}") for m in measures], *[F.count(f"m_{m}").alias(f"c_{m}") for m in means])
        .withColumn("home", F.floor(day_number(F.col("event_day")) / width).cast("int"))
        .withColumn("bucket", F.explode(F.array(F.col("home"), F.col("home") + 1)))
        .drop("home")
        .withColumnRenamed("entity", "e_entity")
        .withColumnRenamed("bucket", "e_bucket")
    )
    within = (
        (F.col("entity") == F.col("e_entity"))
        & (F.col("bucket") == F.col("e_bucket"))
        & (F.col("event_day") <= F.col("day"))
        & (F.col("event_day") >= F.date_sub("day", longest))
    )
    out = []
    for period, days in periods.items():
        inside = F.col("event_day") >= F.date_sub("day", days)
        for m in measures:
            out.append(F.coalesce(F.sum(F.when(inside, F.col(f"s_{m}"))), F.lit(0)).alias(f"{m}_{period}"))
        for m in means:
            total, n = F.sum(F.when(inside, F.col(f"s_{m}"))), F.sum(F.when(inside, F.col(f"c_{m}")))
            out.append(F.try_divide(total.cast("double"), n.cast("double")).alias(f"{m}_mean_{period}"))
    return cal.join(daily, within, "left").groupBy("entity", "bucket", "day").agg(*out).drop("bucket")
