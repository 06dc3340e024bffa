"""Dense panels, paths between anchors, estimates from earlier dates only, and symbols mentioned in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import codes_in


def dense_prices(bars: DataFrame) -> DataFrame:
    """(symbol, date, close, filled): every trading date of the market within a symbol's span, with the last known close.

    The market's dates are one array, bounded by the calendar.
    """
    calendar = bars.agg(F.array_sort(F.collect_set("date"))).scalar()
    spans = bars.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).withColumn("calendar", calendar)
    days = spans.select("symbol", F.explode(F.filter("calendar", lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))).alias("date"))
    joined = days.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")
    known = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("symbol", "date", F.last("close", ignorenulls=True).over(known).alias("close"), F.col("close").isNull().alias("filled"))


def interpolated(anchors: DataFrame, key: list[str], at: str, value: str, steps: int) -> DataFrame:
    """(key, step, value) for steps 1..steps: straight lines between a key's anchors, flat beyond them. One anchor per key and place; null anchors are left out."""
    known = anchors.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    grouped = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("h"), F.col(value).alias("v")))).alias("a"))
    rows = grouped.select(*key, "a", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    lo = F.try_element_at(F.filter("a", lambda x: x["h"] <= F.col("step")), F.lit(-1))
    hi = F.try_element_at(F.filter("a", lambda x: x["h"] >= F.col("step")), F.lit(1))
    rows = rows.select(*key, "step", lo.alias("lo"), hi.alias("hi"))
    share = F.coalesce(F.try_divide(F.col("step") - F.col("lo.h"), F.col("hi.h") - F.col("lo.h")), F.lit(0.0))
    line = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * share
    return rows.select(*key, "step", F.coalesce(line, "lo.v", "hi.v").alias(value))


def expanding_line(rows: DataFrame, least: int = 80) -> DataFrame:
    """(date, known_rows, alpha, beta): the line of y on x through all rows of strictly earlier dates; null below least rows.

    rows: date, x, y. Rows are summed per date; only the daily sums are accumulated, so one task sees one row per date.
    """
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    known = rows.select("date", F.when(both, F.col("x")).alias("x"), F.when(both, F.col("y")).alias("y"))
    daily = known.groupBy("date").agg(F.count("x").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    sums = daily.select("date", *[F.sum(c).over(before).alias(c) for c in ("n", "x", "y", "xy", "xx")])
    spread = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    beta = F.when(spread > 1e-9, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.when(spread > 1e-9, spread)).otherwise(0.0)
    fitted = sums.where(F.col("n") >= least).withColumn("beta", beta)
    return fitted.select("date", F.col("n").alias("known_rows"), ((F.col("y") - F.col("beta") * F.col("x")) / F.col("n")).alias("alpha"), "beta")


def line_probabilities(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows (date, x, y) with prob_up: the line of earlier dates at x, from 0.05 to 0.95; without a line the mean of earlier y, without any 0.5."""
    daily = rows.groupBy("date").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    means = daily.select("date", F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("m_"))
    value = F.col("alpha") + F.col("beta") * F.col("x")
    line = F.when(value.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(0.95), value)))
    joined = rows.join(means, "date").join(lines.select("date", "alpha", "beta"), "date", "left")
    return joined.withColumn("prob_up", F.coalesce(line, "m_", F.lit(0.5))).drop("alpha", "beta", "m_")


def mentioned_symbols(texts: DataFrame, row_id: str, text: str, symbols: DataFrame) -> DataFrame:
    """(row_id, symbol): known symbols whose six-digit code stands in the text, each once. Codes are joined by value, not searched symbol by symbol."""
    found = texts.select(F.col(row_id), F.explode(codes_in(F.col(text))).alias("symbol"))
    return found.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select(row_id, "symbol")
