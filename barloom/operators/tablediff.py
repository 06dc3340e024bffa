"""Differences between two copies of a keyed table, by content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_rows(df: DataFrame, key: list[str], version: str, fields: list[str]) -> DataFrame:
    """One row per key: the one with the greatest version; ties go to the greatest values, nulls first.

    Summed up map-side, so a key with any number of copies sends one row per task. NaN counts as null.
    """
    clean = [F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double")).alias(f) for f in fields]
    narrow = df.select(*[F.col(k).alias(k) for k in key], F.col(version).alias("v_"), *clean)
    best = F.max(F.struct(F.col("v_"), *[F.col(f) for f in fields])).alias("best")
    return narrow.groupBy(*key).agg(best).select(*key, *[F.col(f"best.{f}").alias(f) for f in fields])


def _row_hash(key: list[str], fields: list[str], tolerance: float, seed: int) -> Column:
    # Values on a grid of half the tolerance: noise mostly vanishes, and equal cells never hide a difference beyond it.
    cells = [F.rint(F.col(f) * (2.0 / tolerance)) + F.lit(0.0) if tolerance else F.col(f) for f in fields]
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in key], *[F.coalesce(c, F.lit(float("inf"))) for c in cells], *[c.isNull() for c in cells])


def chunks(df: DataFrame, *, key: list[str], segment: list[str], order: str, fields: list[str], tolerance: float, window: int, mean_rows: int) -> DataFrame:
    """df with hash_, other_hash_ (another seed) and chunk_: rows sorted by order within a segment, cut after a row whose rolling hash over the last `window` rows is divisible by mean_rows.

    The cut depends on content alone, so an inserted or missing row moves only the chunks around it.
    """
    sorted_rows = Window.partitionBy(*segment, "side").orderBy(order)
    rolling = F.sum(F.pmod(F.col("hash_"), F.lit(1 << 31))).over(sorted_rows.rowsBetween(1 - window, 0))
    hashed = df.withColumns({"hash_": _row_hash(key, fields, tolerance, 1), "other_hash_": _row_hash(key, fields, tolerance, 2)})
    cut = hashed.withColumn("cut_", (F.pmod(F.xxhash64(rolling), F.lit(mean_rows)) == 0).cast("int"))
    return cut.withColumn("chunk_", F.coalesce(F.sum("cut_").over(sorted_rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("cut_")


def diff_tables(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: str,
    order: str,
    version: str,
    fields: list[str],
    tolerance: float = 0.001,
    missing_right: str = "missing_in_right",
    missing_left: str = "missing_in_left",
    segment_days: int = 128,
    window: int = 3,
    mean_rows: int = 12,
) -> DataFrame:
    """(entity, order, issue, left_value, right_value): rows missing on either side, and each field that differs.

    Key: (entity, order), order being a date. On each side the row with the greatest version stands for its key. A field
    differs when the values are more than tolerance apart or only one is null or NaN. Rows are cut into segments (an
    entity's days of one calendar span, so at most segment_days rows whatever the skew) and these into content-defined
    chunks. Chunk fingerprints (two 64-bit hashes of the rows under different seeds and the row count) are anti-joined
    within their segment, and only the rows of chunks without a partner are compared field by field.

    Newest rows are found with map-side combining, then both sides are shuffled once by segment; cuts, fingerprints, the
    anti-join (a fingerprint seen on one side only) and the comparison all run on that partitioning.

    Rows with a null entity or order have no key and are left out. Repeated rows count once. An empty side: every row of
    the other is reported missing. Extra columns are never read.
    """
    segment = ["entity", "segment"]
    columns = [f"f_{f}" for f in fields]

    def side(df: DataFrame, right_side: bool) -> DataFrame:
        picked = df.select(F.col(entity).alias("entity"), F.col(order).cast("date").alias("day"), F.lit(right_side).alias("side"), F.col(version).alias("version_"), *[F.col(f).alias(f"f_{f}") for f in fields])
        return picked.where("entity IS NOT NULL AND day IS NOT NULL")

    newest = newest_rows(side(left, False).unionByName(side(right, True)), ["entity", "day", "side"], "version_", columns)
    both = newest.withColumn("segment", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / segment_days).cast("int"))
    rows = chunks(both.repartition(*segment), key=["entity", "day"], segment=segment, order="day", fields=columns, tolerance=tolerance, window=window, mean_rows=mean_rows)
    chunk = Window.partitionBy(*segment, "side", "chunk_")
    printed = rows.select(*segment, "side", "day", *columns, F.expr("bit_xor(hash_)").over(chunk).alias("h1"), F.expr("bit_xor(other_hash_)").over(chunk).alias("h2"), F.count(F.lit(1)).over(chunk).alias("n"))
    same = Window.partitionBy(*segment, "h1", "h2", "n")
    suspects = printed.withColumn("matched", F.min("side").over(same) != F.max("side").over(same)).where("NOT matched")
    value = F.struct(*columns)
    pairs = suspects.groupBy(*segment, "day").agg(F.max(F.when(~F.col("side"), value)).alias("l"), F.max(F.when(F.col("side"), value)).alias("r"))
    issues = [
        F.when(F.col("r").isNull(), F.struct(F.lit(missing_right).alias("issue"), F.lit(None).cast("double").alias("left_value"), F.lit(None).cast("double").alias("right_value"))),
        F.when(F.col("l").isNull(), F.struct(F.lit(missing_left).alias("issue"), F.lit(None).cast("double").alias("left_value"), F.lit(None).cast("double").alias("right_value"))),
    ]
    for f in fields:
        a, b = F.col(f"l.f_{f}"), F.col(f"r.f_{f}")
        differs = F.col("l").isNotNull() & F.col("r").isNotNull() & F.coalesce((F.abs(a - b) > tolerance) & (a != b), a.isNull() != b.isNull())
        issues.append(F.when(differs, F.struct(F.lit(f).alias("issue"), a.alias("left_value"), b.alias("right_value"))))
    return pairs.select("entity", "day", F.explode(F.array_compact(F.array(*issues))).alias("i")).select("entity", "day", "i.issue", "i.left_value", "i.right_value")
