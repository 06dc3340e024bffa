"""Feature tables: factors with labels and events, what they cover, and where they come from."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event columns that join a panel: numbers become 0 where there is no event, texts ''.
EVENT_NUMBERS = ("event_count_3d", "event_count_20d", "positive_event_count", "negative_event_count", "event_risk_count", "event_impact_score", "event_weighted_impact_score", "event_confidence_mean", "event_reliability_mean")
EVENT_TEXTS = ("latest_event_type", "latest_event_title")


def with_event_factors(panel: DataFrame, factors: DataFrame, sequence: str) -> DataFrame:
    """panel with the event columns of its date and symbol; of repeated factor rows the one with the greatest sequence counts.

    Columns factors lacks are left out; nulls and missing rows become 0 or ''. Factor rows without a date count for nothing.
    """
    numbers = [x for x in EVENT_NUMBERS if x in factors.columns]
    texts = [x for x in EVENT_TEXTS if x in factors.columns]
    last = factors.where("date IS NOT NULL").groupBy("date", "symbol").agg(F.max_by(F.struct(*[F.col(x).cast("double").alias(x) for x in numbers], *texts), sequence).alias("e_"))
    joined = panel.join(last, ["date", "symbol"], "left")
    return joined.select(*panel.columns, *[F.coalesce(f"e_.{x}", F.lit(0.0)).alias(x) for x in numbers], *[F.coalesce(f"e_.{x}", F.lit("")).alias(x) for x in texts])


def feature_version(features: Sequence[str], horizons: Sequence[int], source: str) -> str:
    """Twelve hex digits that change with the features, their order, the horizons or the source."""
    return hashlib.sha1("|".join([source, ",".join(features), ",".join(map(str, horizons))]).encode()).hexdigest()[:12]


def feature_store(panel: DataFrame, labels: DataFrame, events: DataFrame, *, sequence: str, features: Sequence[str], horizons: Sequence[int], source: str) -> DataFrame:
    """panel with labels, event columns, the source, the feature version and the date the row is in force. labels: one row per date and symbol."""
    joined = with_event_factors(panel.join(labels, ["date", "symbol"], "left"), events, sequence)
    return joined.withColumns({"source": F.lit(source), "feature_version": F.lit(feature_version(features, horizons, source)), "effective_date": F.col("date")})


def feature_audit(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, coverage, nonzero_ratio, mean_abs_value, distinct_values, quality_status, failed_reasons), in one pass over frame.

    A feature frame lacks is reported as missing. An empty frame covers nothing. Equal values are counted together
    first, map-side, so what is shuffled are distinct values.
    """
    have = [f for f in features if f in frame.columns]
    spark = frame.sparkSession
    every = spark.createDataFrame([(f,) for f in features], "feature string")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in have])).alias("p")
    values = frame.select(pairs).select("p.*") if have else spark.createDataFrame([], "feature string, v double")
    n, size = F.col("n"), F.abs(F.coalesce("v", F.lit(0.0)))
    rows = values.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(
        F.sum("n").alias("all_"), F.sum(F.when(F.col("v").isNotNull(), n)).alias("known"), F.sum(F.when(size > 1e-12, n)).alias("nonzero"), F.sum(n * size).alias("mass"), F.count("v").alias("distinct_values")
    )
    share = lambda x: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("all_").cast("double")), F.lit(0.0)).alias
    rows = every.join(rows, "feature", "left").select("feature", share("known")("coverage"), share("nonzero")("nonzero_ratio"), share("mass")("mean_abs_value"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))
    absent = [f for f in features if f not in have]
    missing = F.col("feature").isin(absent) if absent else F.lit(False)
    failed = F.array_compact(
        F.array(
            F.when(missing, "missing_feature_column"),
            F.when(~missing & (F.col("coverage") < 0.95), "low_matrix_coverage"),
            F.when(~missing & (F.col("nonzero_ratio") <= 0), "all_zero_event_feature"),
            F.when((F.col("nonzero_ratio") > 0) & (F.col("nonzero_ratio") < 0.01), "sparse_event_signal"),
            F.when(~missing & (F.col("distinct_values") < 2), "constant_event_feature"),
        )
    )
    rows = rows.withColumn("failed", failed)
    grave = F.arrays_overlap("failed", F.array(*[F.lit(r) for r in ("missing_feature_column", "all_zero_event_feature", "constant_event_feature")]))
    status = F.when(F.size("failed") == 0, "approved").when(grave, "quarantine").otherwise("watchlist")
    return rows.select("feature", "coverage", "nonzero_ratio", "mean_abs_value", "distinct_values", status.alias("quality_status"), F.when(F.size("failed") == 0, "passed").otherwise(F.array_join("failed", ";")).alias("failed_reasons"))


def feature_coverage(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, coverage), in one pass; 0 for an empty frame."""
    n = F.count(F.lit(1)).cast("double")
    shares = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.try_divide(F.count(f).cast("double"), n), F.lit(0.0)).alias("coverage")) for f in features])
    return frame.agg(shares.alias("a")).select(F.explode("a").alias("a")).select("a.*")


def covered(frame: DataFrame, features: Sequence[str], least: float = 0.55) -> list[str]:
    """The features known in at least this share of rows, in their order. One row per feature reaches the driver."""
    known = {r.feature for r in feature_coverage(frame, features).where(F.col("coverage") >= least).collect()}
    return [f for f in features if f in known]


def store_summary(store: DataFrame, features: Sequence[str], least: float = 0.60) -> DataFrame:
    """One row: rows, symbols, span, number of features and those known in less than least of the rows, least covered first."""
    per = store.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    low = feature_coverage(store, features).where(F.col("coverage") < least).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("coverage", "feature"))), lambda x: x["feature"]), ";").alias("low_coverage_features"))
    return per.crossJoin(low).withColumn("feature_count", F.lit(len(features)))  # one row with one row


def audit_columns(df: DataFrame, source: str, day: str | None = "date", flag: str = "ok") -> DataFrame:
    """df with audit_source, audit_quality_flag and audit_raw_hash, and with source, quality_flag, effective_date, announce_date and raw_hash where it lacks them."""
    columns = df.columns
    out = df.withColumns({"audit_source": F.lit(source), "audit_quality_flag": F.lit(flag), "audit_raw_hash": F.xxhash64(*[F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in columns]).cast("string")})
    absent = {"source": F.lit(source), "quality_flag": F.lit(flag), "effective_date": F.to_date(day) if day in columns else F.lit(None).cast("date"), "announce_date": F.lit(None).cast("date"), "raw_hash": F.col("audit_raw_hash")}
    return out.withColumns({k: v for k, v in absent.items() if k not in columns})


def data_digest(df: DataFrame, entity: str, day: str) -> DataFrame:
    """(digest, entities): SHA-1 of 'entity:first:last:rows' of all entities in order. Equal tables have equal digests.

    One short text per entity is brought together; rows are counted before.
    """
    per = df.groupBy(entity).agg(F.min(day).alias("lo"), F.max(day).alias("hi"), F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(":", F.coalesce(F.col(entity), F.lit("")), F.coalesce(F.col("lo").cast("date").cast("string"), F.lit("")), F.coalesce(F.col("hi").cast("date").cast("string"), F.lit("")), F.col("n").cast("string"))
    return per.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(text)), "|")).alias("digest"), F.count(F.lit(1)).alias("entities"))


def z_scores(panel: DataFrame, columns: Sequence[str], group: str = "date") -> DataFrame:
    """panel with <column>_zscore against its group; null without spread."""
    whole = Window.partitionBy(group)
    return panel.withColumns({f"{x}_zscore": F.when(F.stddev_samp(x).over(whole) > 0, (F.col(x) - F.avg(x).over(whole)) / F.stddev_samp(x).over(whole)) for x in columns})


def squashed(rows: DataFrame, group: Sequence[str], value: str, out: str = "prob_up") -> DataFrame:
    """rows with out: the logistic of value standardised within its group, from 0.05 to 0.95; an unknown value counts as 0."""
    per = rows.groupBy(*group).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("m_"), F.stddev_pop(F.coalesce(value, F.lit(0.0))).alias("s_"))
    z = (F.coalesce(value, F.lit(0.0)) - F.col("m_")) / F.when(F.col("s_") > 0, F.col("s_")).otherwise(1.0)
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 / (1 + F.exp(-z))))
    return rows.join(per, list(group)).withColumn(out, p).drop("m_", "s_")


def nearest_horizon(rows: DataFrame, keys: Sequence[str], horizon: str, wanted: int) -> DataFrame:
    """Per key the row whose horizon is closest to the wanted one; of two the shorter. Rows with a null horizon count for nothing."""
    rest = [x for x in rows.columns if x not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.abs(F.col(horizon) - wanted), horizon))
    return rows.where(F.col(horizon).isNotNull()).groupBy(*keys).agg(best.alias("b_")).select(*keys, "b_.*")


def limited_scope(events: DataFrame, symbols: DataFrame, target: str, most_symbols: int, most_events: int) -> DataFrame:
    """events of the target and the symbols with most events, and of these the best most_events rows: a top-k report.

    Symbols: the target first, then by number of events, then by symbol; those of symbols without events fill up. Events:
    of the target first, then by source_reliability, entity_link_confidence, size of weighted_impact_score, published_at
    and row_id. A limit of 0 does not apply.
    """
    counts = symbols.select("symbol").distinct().join(events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "left")
    chosen = counts.orderBy(F.desc(F.col("symbol") == target), F.desc_nulls_last("n"), "symbol")
    chosen = chosen.limit(most_symbols) if most_symbols > 0 else chosen
    scoped = events.join(chosen.select("symbol"), "symbol", "left_semi")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    ranked = scoped.orderBy(F.desc(F.col("symbol") == target), F.desc(zero("source_reliability")), F.desc(zero("entity_link_confidence")), F.desc(F.abs(zero("weighted_impact_score"))), F.desc_nulls_last("published_at"), "row_id")
    return ranked.limit(most_events) if most_events > 0 else scoped


def intraday_checkpoints(days: DataFrame, points: int) -> DataFrame:
    """days with (label, progress, wave) of 6 to 48 evenly spaced moments of a session from 9:30 to 11:30 and 13:00 to 15:00."""
    n = max(6, min(48, int(points)))
    marks = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    minute = F.bround(F.col("k") * F.lit(240.0 / (n - 1)), 0).cast("int")
    clock: Column = F.when(minute <= 120, 570 + minute).otherwise(660 + minute)
    ends = (F.col("k") == 0) | (F.col("k") == n - 1)
    clock = F.when(F.col("k") == 0, 570).when(F.col("k") == n - 1, 900).otherwise(clock)
    label = F.format_string("%02d:%02d", F.floor(clock / 60).cast("int"), (clock % 60).cast("int"))
    p = minute / 240.0
    wave = F.when(ends, 0.0).otherwise(F.sin(p * 2.5 * F.pi()) * (1 - F.abs(p - 0.55) * 0.55))
    return days.select("*", marks).withColumns({"label": label, "progress": p, "wave": wave}).drop("k")


def fitted_split(dates: DataFrame, share: float = 0.8, least: int = 30) -> DataFrame:
    """(date, role): the first share of the distinct dates trains, the rest tests; below least dates all train."""
    n = dates.select("date").where("date IS NOT NULL").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))  # a calendar
    first = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return n.select("date", F.when((F.col("n") < least) | (F.col("i") <= first), "train").otherwise("test").alias("role"))


def calibration_split(dates: DataFrame, embargo: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, role): of each key's dates the last fifth, 20 at least, calibrates, the ones before less embargo fit the model; the rest is unused.

    Below 60 dates, or where fewer than 20 would fit or 5 calibrate, all fit.
    """
    order, whole = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys)
    n = dates.select(*keys, "date").distinct().select(*keys, "date", F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    start = F.greatest(F.lit(1), F.col("n") - F.greatest(F.lit(20), F.floor(F.col("n") * 0.2)))
    end = F.greatest(F.lit(1), start - embargo)
    whole_only = (F.col("n") < 60) | (end < 20) | (F.col("n") - start < 5)
    role = F.when(whole_only | (F.col("i") <= end), "model").when(F.col("i") > start, "calibration").otherwise("embargo")
    return n.select(*keys, "date", role.alias("role"))
