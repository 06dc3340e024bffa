"""Ranks over groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def _placed_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n_, less_): each distinct value with its rows and the rows below it in its group.

    Equal values are counted first, with map-side combining, then range-partitioned; each partition counts its own
    stretch and adds the totals of the stretches before it. No task sees more than a stretch of distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_"))
    ranged = cut_lineage(counts.repartitionByRange(*groups, value).withColumn("part_", F.spark_partition_id()))
    stretch = ranged.groupBy(*groups, "part_").agg(F.sum("n_").alias("held_"))
    earlier = Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretch.select(*groups, "part_", F.coalesce(F.sum("held_").over(earlier), F.lit(0)).alias("offset_"))
    below = F.coalesce(F.sum("n_").over(Window.partitionBy(*groups, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(offsets, [*groups, "part_"]).select(*groups, value, "n_", (F.col("offset_") + below).alias("less_"))


def pooled_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str, ties: str | None = None) -> DataFrame:
    """df with out: the average rank of value within its group, however large the group; null for a null value.

    With ties, also how many rows share the value. Rows with a null group get no rank.
    """
    groups = list(groups)
    placed = _placed_values(df, groups, value)
    ranked = placed.select(*groups, value, (F.col("less_") + (F.col("n_") + 1) / 2.0).alias(out), *([F.col("n_").alias(ties)] if ties else []))
    return df.join(ranked, [*groups, value], "left")


def pooled_quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, <name>): interpolated quantiles of value per group, however large the group. Groups may not be null."""
    groups = list(groups)
    placed = _placed_values(df, groups, value)
    totals = placed.groupBy(*groups).agg(F.sum("n_").alias("all_"))
    covers = lambda place: F.max(F.when((F.col("less_") < place) & (place <= F.col("less_") + F.col("n_")), F.col(value)))
    out = []
    for name, q in shares.items():
        at = F.round((F.col("all_") - 1) * q, 9)
        low, part = F.floor(at), at - F.floor(at)
        out.append((covers(low + 1) + F.max(part) * (covers(F.least(low + 2, F.col("all_"))) - covers(low + 1))).alias(name))
    return placed.join(totals, groups).groupBy(*groups).agg(*out)


def pooled_medians(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """(groups, out): the median of value per group, however large the group. Groups may not be null."""
    return pooled_quantiles(df, groups, value, {out: 0.5})
