"""Bars from vendors' layouts, generated bars, and sets of result tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("date", "open", "high", "low", "close", "volume", "amount", "turnover")
#: Names under which vendors deliver the fields.
ALIASES = {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "换手率": "turnover", "trade_date": "date", "vol": "volume"}
#: The columns of a twelve-column table without known names.
POSITIONS = {0: "date", 2: "open", 3: "close", 4: "high", 5: "low", 6: "volume", 7: "amount", 11: "turnover"}


def named_fields(raw: DataFrame, aliases: Mapping[str, str] = ALIASES, positions: Mapping[int, str] = POSITIONS, scales: Mapping[str, float] | None = None) -> DataFrame:
    """FIELDS of raw, found by name or alias, letter case and blanks aside, else by position; numbers scaled by scales.

    Positions are used only where fields are missing by name and the table is wide enough. A cell that is no number or
    date becomes null. Other columns are left out; missing fields raise.
    """
    known = {name: aliases.get(name.strip().lower(), aliases.get(name.strip(), name.strip().lower())) for name in raw.columns}
    found = {}
    for name, field in known.items():
        found.setdefault(field, name)
    if any(f not in found for f in FIELDS) and len(raw.columns) > max(positions):
        found = {field: raw.columns[k] for k, field in positions.items()}
    absent = [f for f in FIELDS if f not in found]
    if absent:
        raise ValueError(f"no columns for {', '.join(absent)}")
    cell = lambda f: F.col(f"`{found[f]}`").cast("string")
    day = F.coalesce(F.try_to_date(cell("date"), "yyyy-MM-dd"), F.try_to_date(cell("date"), "yyyyMMdd"), F.try_to_date(F.substring(cell("date"), 1, 10), "yyyy-MM-dd"))
    number = lambda f: cell(f).try_cast("double") * float((scales or {}).get(f, 1.0))
    return raw.select(day.alias("date"), *[number(f).alias(f) for f in FIELDS[1:]])


def exchange_code(symbol: Column) -> Column:
    """A six-digit code with its exchange: 4 and 8 are BJ, 5, 6 and 9 SH, the rest SZ."""
    first = F.substring(symbol, 1, 1)
    return F.concat(symbol, F.when(first.isin("4", "8"), ".BJ").when(first.isin("5", "6", "9"), ".SH").otherwise(".SZ"))


def generated_bars(spark: SparkSession, symbols: Sequence[str], start: str, end: str, seed: int = 20260611) -> DataFrame:
    """(symbol, *FIELDS): made-up bars on every weekday, the same for the same symbols, dates and seed on any number of tasks.

    Noise comes from hashes of symbol, date and seed, so no generator runs through the rows; returns stay within 9.5 percent.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    grid = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string").crossJoin(F.broadcast(days))  # a calendar for every symbol: the result itself
    unit = lambda k, *on: (F.pmod(F.xxhash64(*[F.col(c) for c in on], F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda k, *on: F.sqrt(-2 * F.log(unit(k, *on))) * F.cos(2 * F.pi() * unit(k + 1, *on))
    both = ("symbol", "date")
    move = F.greatest(F.lit(-0.095), F.least(F.lit(0.095), 0.00025 + 0.008 * normal(1, "date") + 0.018 * normal(3, *both)))
    order = Window.partitionBy("symbol").orderBy("date")
    close = (8 + F.pmod(F.xxhash64("symbol"), F.lit(120))) * F.exp(F.sum(F.log(1 + F.col("r"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = grid.withColumn("r", move).withColumn("close", close)
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(order), F.col("close") / (1 + F.col("r"))) * (1 + 0.003 * normal(5, *both)))
    rows = rows.withColumns({"high": F.greatest("open", "close") * (1.001 + 0.017 * unit(7, *both)), "low": F.least("open", "close") * (0.999 - 0.017 * unit(8, *both)), "volume": F.floor(40_000 + 2_460_000 * unit(9, *both)) * 100.0})
    return rows.withColumns({"amount": F.col("volume") * F.col("close"), "turnover": 0.3 + 7.7 * unit(10, *both)}).select("symbol", *FIELDS)


def collected_files(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The tables at paths, each path once, united by name: a column one lacks is null there; `file` names each row's source."""
    options = {"header": "true"} if fmt == "csv" else {}
    parts = [spark.read.format(fmt).options(**options).load(p).withColumn("file", F.input_file_name()) for p in dict.fromkeys(paths)]
    if not parts:
        raise ValueError("no paths")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_bundle(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", notes: Mapping[str, object] | None = None) -> DataFrame:
    """Write each table under root and a manifest of name, format, columns and rows beside them; the manifest is returned.

    Rows are counted from what was written. notes go into the manifest as JSON.
    """
    spark = next(iter(tables.values())).sparkSession
    lines = []
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(f"{root}/{name}")
        lines.append((name, fmt, ",".join(df.columns), spark.read.schema(df.schema).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(f"{root}/{name}").count(), json.dumps(dict(notes or {}), sort_keys=True)))
    manifest = spark.createDataFrame(lines, "name string, format string, columns string, rows long, notes string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return manifest
