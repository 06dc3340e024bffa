"""Attributes as known at event time: version numbers by cumulative change counts, then an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

BLOCK_DAYS = 32
#: An entity with more than this share of all events is hot; so there are fewer than 64 hot ones.
HOT_SHARE = 1 / 64


def _block(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BLOCK_DAYS).cast("int")


def version_numbers(changes: DataFrame, queries: DataFrame, entity: Sequence[str], time: str, carry: Sequence[str], bucket: str = "day") -> DataFrame:
    """queries with number_: how many distinct change times of its entity are at or before its time (0 before the first).

    changes: one row per entity and distinct change time; queries: entity columns, time and the columns in carry.
    A cumulative count in two levels: totals per (entity, time bucket) are accumulated on their own, small, table, then
    changes and queries are counted within a bucket only. So no task holds more than one bucket of an entity.
    """
    entity = list(entity)
    tagged_changes = changes.select(*entity, F.col(time).alias("t_"), F.lit(0).alias("kind_"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in carry])
    tagged_queries = queries.select(*entity, F.col(time).alias("t_"), F.lit(1).alias("kind_"), *carry)
    narrow = tagged_changes.unionByName(tagged_queries).withColumn("bucket_", F.date_trunc(bucket, F.col("t_")))
    per_bucket = narrow.groupBy(*entity, "bucket_").agg(F.sum(1 - F.col("kind_")).alias("n_"))
    before = Window.partitionBy(*entity).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*entity, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    within = Window.partitionBy(*entity, "bucket_").orderBy("t_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    counted = narrow.join(offsets, [*entity, "bucket_"]).withColumn("number_", F.col("offset_") + F.sum(1 - F.col("kind_")).over(within))
    return counted.where("kind_ = 1").select(*entity, F.col("t_").alias(time), *carry, "number_")


def day_in_force(events: DataFrame, versions: DataFrame, salt: int) -> DataFrame:
    """events (entity, event_id, limit_day, known_by) with day: the latest version day <= limit_day of which a version was known by known_by.

    Version days of an entity lie in blocks of BLOCK_DAYS calendar days, each block one row with its days and when each
    became known. An event looks into its own block and, where nothing there was known yet, into the latest earlier block
    with something known: two equi-joins, whatever the lookback. Blocks of entities that hold more than HOT_SHARE of all
    events are replicated salt times and their events spread over the copies; those of all others are there once.
    """
    per = events.groupBy("entity").agg(F.count(F.lit(1)).alias("n_"))
    total = per.agg(F.sum("n_")).scalar()
    hot = F.broadcast(cut_lineage(per.where(F.col("n_") > total * HOT_SHARE).select("entity", F.lit(salt).alias("salts_"))))
    salted = lambda df: df.join(hot, "entity", "left").withColumn("salts_", F.coalesce("salts_", F.lit(1)))
    days = versions.groupBy("entity", "day").agg(F.min("known_at").alias("known_at"))
    blocks = days.groupBy("entity", _block(F.col("day")).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("day", "known_at"))).alias("days"), F.min("known_at").alias("first_known")
    )
    asked = events.select("entity", _block(F.col("limit_day")).alias("block")).distinct()
    spine = blocks.unionByName(asked, allowMissingColumns=True).groupBy("entity", "block").agg(F.first("days", ignorenulls=True).alias("days"), F.min("first_known").alias("first_known"))
    before = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("first_known").isNotNull(), F.struct("block", "first_known"))
    spine = spine.select("entity", "block", "days", F.collect_list(known).over(before).alias("earlier"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts_") - 1)).alias("salt")
    slot = F.pmod(F.xxhash64("event_id"), F.col("salts_")).cast("int")

    def latest_known(array: str, field: str, extra: Column | None = None) -> Column:
        ok = F.filter(array, lambda e: (e["known_at" if field == "day" else "first_known"] <= F.col("known_by")) & (e["day"] <= F.col("limit_day") if field == "day" else F.lit(True)))
        return F.try_element_at(ok, F.lit(-1))[field]

    own = salted(events).withColumn("block", _block(F.col("limit_day"))).withColumn("salt", slot).drop("salts_")
    own = own.join(salted(spine).select("*", salts).drop("salts_"), ["entity", "block", "salt"])
    own = own.select("entity", "event_id", "limit_day", "known_by", "salt", latest_known("days", "day").alias("day"), latest_known("earlier", "block").alias("back"))
    # Events that need no second look get a key without a partner, spread evenly.
    nowhere = -1_000_000 - F.pmod(F.xxhash64("event_id"), F.lit(4096)).cast("int")
    own = own.withColumn("block", F.when(F.col("day").isNull(), F.col("back")))
    own = own.withColumn("block", F.coalesce("block", nowhere)).drop("back")
    far = own.join(salted(blocks).select("entity", "block", "days", salts), ["entity", "block", "salt"], "left")
    found = F.coalesce("day", latest_known("days", "day"))
    return far.select("entity", "event_id", "known_by", found.alias("day")).where("day IS NOT NULL")


def attributes_as_of(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: str,
    event_entity: str,
    event_time: str,
    event_day: str,
    version_id: str,
    version_entity: str,
    version_day: str,
    version_time: str,
    attributes: Sequence[str] = (),
    salt: int = 8,
) -> DataFrame:
    """(event_id, version_id, *attributes): each event with the version of its entity in force and known at event time.

    Versions with day <= the event's day and known time <= the event's time qualify; of these the latest day wins, then
    the latest known time, then the smallest version id. Events without one are left out, as are events and versions
    with a null in any of these key columns. Repeated versions (same entity, day and known time) collapse to the one
    with the smallest id. Repeated events keep one row each. Attributes may be null; other columns are never read.

    Only narrow rows take part in finding the day in force and the version number; the wide attribute rows move once,
    for the equi-join on entity, day and number.
    """
    ev = events.select(F.col(event_id).alias("event_id"), F.col(event_entity).alias("entity"), F.col(event_day).cast("date").alias("limit_day"), F.col(event_time).alias("known_by")).dropna()
    key = [F.col(version_entity).alias("entity"), F.col(version_day).cast("date").alias("day"), F.col(version_time).alias("known_at")]
    have = F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("known_at").isNotNull() & F.col("version_id").isNotNull()
    picked = versions.select(*key, F.col(version_id).alias("version_id"), *[F.col(a).alias(f"a_{a}") for a in attributes]).where(have)
    placed = day_in_force(ev, picked.select("entity", "day", "known_at"), salt)
    changes = picked.select("entity", "day", "known_at").distinct()
    numbered = version_numbers(changes, placed.withColumnRenamed("known_by", "known_at"), ["entity", "day"], "known_at", ["event_id"])
    payload = F.struct("version_id", *[f"a_{a}" for a in attributes])
    wide = picked.groupBy("entity", "day", "known_at").agg(F.min_by(payload, "version_id").alias("p"))
    order = Window.partitionBy("entity", "day").orderBy("known_at")
    wide = wide.select("entity", "day", F.row_number().over(order).cast("long").alias("number_"), "p")
    return numbered.join(wide, ["entity", "day", "number_"]).select("event_id", "p.version_id", *[F.col(f"p.a_{a}").alias(a) for a in attributes])
