"""Checks and cleaning of daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
CELLS = [*PRICES, "volume", "amount", "turnover"]


def normalize_bars(raw: DataFrame, sequence: str) -> DataFrame:
    """Typed bars with positive prices and amount; of several rows of a symbol and date the one with the greatest sequence stays."""
    typed = raw.select(F.to_date("date").alias("date"), F.lpad(F.right(F.regexp_replace(F.col("symbol").cast("string"), r"\D", ""), F.lit(6)), 6, "0").alias("symbol"), *[F.expr(f"try_cast({x} AS double)").alias(x) for x in CELLS], F.col(sequence).alias("s_"))
    sound = typed.where("date IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND amount > 0 AND NOT isnan(close)")
    last = sound.groupBy("date", "symbol").agg(F.max_by(F.struct(*CELLS), "s_").alias("row"))
    return last.select("date", "symbol", "row.*")


def business_days(lo: str, hi: str) -> str:
    """SQL for the number of weekdays from lo to hi, both included, without building them."""
    return f"(datediff({hi}, {lo}) + 1 - (datediff(next_day({hi}, 'SAT'), next_day(date_sub({lo}, 1), 'SAT')) div 7) - (datediff(next_day({hi}, 'SUN'), next_day(date_sub({lo}, 1), 'SUN')) div 7))"


def quality_summary(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, span, share of business days without a bar, repeated dates, null cells and impossible rows."""
    nulls = sum((F.col(x).isNull().cast("int") for x in CELLS), F.lit(0))
    odd = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    per = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        (F.count("date") - F.count_distinct("date")).alias("duplicate_dates"),
        F.sum(nulls).alias("missing_cells"),
        F.count_if(F.least(*PRICES) <= 0).alias("non_positive_price_rows"),
        F.count_if(odd).alias("high_low_error_rows"),
        F.count_if(F.col("amount") < 0).alias("amount_error_rows"),
    )
    share = F.greatest(F.lit(0.0), 1 - F.col("rows") / F.greatest(F.lit(1), F.expr(business_days("start_date", "end_date"))))
    return per.withColumn("missing_ratio", share)


def quality_issues(bars: DataFrame) -> DataFrame:
    """(symbol, issue, count) for every kind of issue that occurs."""
    kinds = {"duplicate_dates": "duplicate_dates", "missing_cells": "missing_cells", "non_positive_price": "non_positive_price_rows", "high_low_error": "high_low_error_rows", "amount_error": "amount_error_rows"}
    wide = quality_summary(bars).select("symbol", *[F.col(v).alias(k) for k, v in kinds.items()])
    return wide.unpivot(["symbol"], list(kinds), "issue", "count").where("count > 0")


def table_audit(tables: dict[str, DataFrame], keys: dict[str, list[str]], day: dict[str, str]) -> DataFrame:
    """Per table: rows, columns, first and last day, share of null cells and rows beyond the first of their key."""
    parts = []
    for name, df in tables.items():
        nulls = sum((F.col(x).isNull().cast("long") for x in df.columns), F.lit(0))
        per_key = df.groupBy(*keys[name]).agg(F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls"), F.min(day[name]).alias("lo"), F.max(day[name]).alias("hi"))
        parts.append(
            per_key.agg(F.sum("n").alias("rows"), F.min("lo").cast("date").alias("first_day"), F.max("hi").cast("date").alias("last_day"), F.sum("nulls").alias("nulls"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_keys"))
            .select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "first_day", "last_day", F.try_divide("nulls", F.col("rows") * len(df.columns)).alias("missing_ratio"), "duplicate_keys")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bar_issues(bars: DataFrame, jump: float = 0.25) -> DataFrame:
    """(issue, count): rows without positive prices, returns beyond jump, rows without amount."""
    previous = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    moved = bars.select(*PRICES, "amount", (F.try_divide(F.col("close"), previous) - 1).alias("r"))
    per = moved.agg(
        F.count_if(~F.coalesce(F.least(*PRICES) > 0, F.lit(False))).alias("non_positive_price"),
        F.count_if(F.abs("r") > jump).alias("abnormal_return"),
        F.count_if(F.coalesce("amount", F.lit(0.0)) <= 0).alias("zero_or_missing_amount"),
    )
    return per.unpivot([], per.columns, "issue", "count").where("count > 0")


def relative_differences(left: DataFrame, right: DataFrame, limits: dict[str, float], key: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    """(key, field, diff): values of two sources further apart than the field's limit, relative to the right one."""
    a = left.select(*key, *[F.col(f).alias(f"l_{f}") for f in limits])
    b = right.select(*key, *[F.col(f).alias(f"r_{f}") for f in limits])
    diffs = [F.struct(F.lit(f).alias("field"), F.try_divide(F.abs(F.col(f"l_{f}") - F.col(f"r_{f}")), F.col(f"r_{f}")).alias("diff"), F.lit(limit).alias("limit")) for f, limit in limits.items()]
    return a.join(b, list(key)).select(*key, F.explode(F.array(*diffs)).alias("d")).where("d.diff > d.limit").select(*key, "d.field", "d.diff")


def universe_report(bars: DataFrame, *, least_rows: int, most_missing: float, least_amount: float, excluded: tuple[str, ...] = (), recent: int = 60) -> DataFrame:
    """(symbol, passed, rows, missing_ratio, avg_amount_60, reasons) of each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    per = bars.select("symbol", "date", "amount", F.row_number().over(newest).alias("n")).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("lo"), F.max("date").alias("hi"), F.avg(F.when(F.col("n") <= recent, F.col("amount"))).alias("avg_amount_60")
    )
    per = per.withColumn("missing_ratio", F.greatest(F.lit(0.0), 1 - F.col("rows") / F.greatest(F.lit(1), F.expr(business_days("lo", "hi")))))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("symbol").isin(list(excluded)), "excluded_by_config"),
            F.when(F.col("rows") < least_rows, "insufficient_history"),
            F.when(F.col("missing_ratio") > most_missing, "too_many_missing_days"),
            F.when(F.col("avg_amount_60") < least_amount, "low_amount"),
        )
    )
    return per.select("symbol", (F.size(reasons) == 0).alias("passed"), "rows", "missing_ratio", "avg_amount_60", F.array_join(reasons, ";").alias("reasons"))
