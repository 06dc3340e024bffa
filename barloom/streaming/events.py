"""Event operators on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str, schema: object) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, *, time: str, key: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(key, window_start, events) over tumbling or sliding windows; events later than `late` are left out."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(key, window).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("window.start").alias("window_start"), "events")


def first_deliveries(events: DataFrame, *, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, when it is first delivered; state is kept only as long as repeats may arrive.

    Only the key comes out: which delivery is met first depends on the order of files and partitions.
    """
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key).select(*key)


def matched_within(left: DataFrame, right: DataFrame, *, key: str, time: str, span: str, late: str = "1 day") -> DataFrame:
    """(key, left_time, right_time): pairs of two streams on a key, the right one at most span after the left one.

    Both watermarks and the interval bound the state on either side.
    """
    a = left.select(F.col(key).alias("key_"), F.col(time).alias("left_time")).withWatermark("left_time", late)
    b = right.select(F.col(key).alias("other_"), F.col(time).alias("right_time")).withWatermark("right_time", late)
    near = F.expr(f"key_ = other_ AND right_time >= left_time AND right_time <= left_time + INTERVAL {span}")
    return a.join(b, near).select(F.col("key_").alias(key), "left_time", "right_time")


def session_counts(events: DataFrame, *, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, events) of runs of events less than gap apart."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there and read what it wrote, from the shared checkpoint folder; its state is removed."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"))
    writer.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
