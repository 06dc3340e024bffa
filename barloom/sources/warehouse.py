"""Named tables under one root, with a manifest; CSV, JSON and Parquet; several sources in order of preference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


class Warehouse:
    """Tables as folders under root. Each write adds a line to the manifest; the newest line of a name counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt}")
        options = {"header": "true"} if fmt == "csv" else {}
        df.write.mode(mode).format(fmt).options(**options).partitionBy(*partition_by).save(f"{self.root}/{name}")
        line = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(fmt).alias("format"), F.lit(df.schema.json()).alias("schema"), F.current_timestamp().alias("written_at"))
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest.tables")

    def manifest(self) -> DataFrame:
        """(name, format, schema, written_at), one row per table."""
        lines = self.spark.read.parquet(f"{self.root}/manifest.tables")
        return lines.groupBy("name").agg(F.max_by(F.struct("format", "schema"), "written_at").alias("x"), F.max("written_at").alias("written_at")).select("name", "x.format", "x.schema", "written_at")

    def read(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType
        import json

        line = self.manifest().where(F.col("name") == name).first()
        if line is None:
            raise KeyError(name)
        schema = StructType.fromJson(json.loads(line.schema))
        options = {"header": "true"} if line.format == "csv" else {}
        return self.spark.read.format(line.format).options(**options).schema(schema).load(f"{self.root}/{name}")


def first_available(sources: Sequence[tuple[str, Callable[[], DataFrame]]], key: Sequence[str]) -> DataFrame:
    """Union of the sources where an earlier one wins per key; `source` names the one used. A source that cannot be opened, or whose first row cannot be read, is passed over."""
    opened = []
    for place, (name, load) in enumerate(sources):
        try:
            df = load()
            df.take(1)
            opened.append(df.withColumns({"source": F.lit(name), "place_": F.lit(place)}))
        except Exception:  # noqa: BLE001 - any reader may fail in its own way
            continue
    if not opened:
        raise ValueError("no source could be opened")
    every = opened[0]
    for df in opened[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*key, "place_")]
    best = every.groupBy(*key).agg(F.min_by(F.struct(*rest), "place_").alias("x"))
    return best.select(*key, "x.*")


def missing(wanted: DataFrame, have: DataFrame, key: Sequence[str]) -> DataFrame:
    """Wanted keys that have lacks."""
    return wanted.select(*key).distinct().join(have.select(*key), list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)
