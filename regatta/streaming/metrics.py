"""Windowed metrics, quorum and exactly-once actions on event streams, with built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators.aggregate import to_long

EVENT_SCHEMA = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)


def event_stream(
    spark: SparkSession, folder: str, pattern: str = "events*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Event files of a folder as a stream; ``ts`` becomes a timestamp a watermark accepts."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def round_metrics(stream: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Mean and population deviation of the loss per window and experiment."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.col("event_type").alias("experiment"))
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
             F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "experiment", "mean", "std", "n")
    )


def quorum(
    stream: DataFrame, least: int, late: str = "10 minutes", width: str = "1 day"
) -> DataFrame:
    """``(start, entities, rows)`` of windows with at least ``least`` entities before the watermark passed.

    Two chained windowed counts give the exact distinct number, which a stream cannot count at once.
    ``rows`` are those that were counted; ``late_rows`` tells how many came after.
    """
    per_entity = (
        stream.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_entity.groupBy(F.window(F.window_time("window"), width))
        .agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"))
        .filter(F.col("entities") >= least)
        .select(F.col("window.start").alias("start"), "entities", "rows")
    )


def window_rows(batch: DataFrame, width: str = "1 day") -> DataFrame:
    """``(start, seen)`` of a batch: all its rows per window, late or not. For ``run_partials``."""
    return batch.groupBy(F.window("ts", width).alias("window")).agg(F.count(F.lit(1)).alias("seen")).select(
        F.col("window.start").alias("start"), "seen"
    )


def late_rows(counted: DataFrame, partials: DataFrame) -> DataFrame:
    """``counted (start, ..., rows)`` with ``late``: rows of the window that the watermark left out.

    What all batches brought less what the closed window counted, so it is exact whatever the watermark did.
    """
    seen = partials.groupBy("start").agg(F.sum("seen").alias("_seen"))
    return counted.join(seen, "start").withColumn("late", F.col("_seen") - F.col("rows")).drop("_seen")


def once_per_round(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """First event of every ``(entity, round)``; copies within the watermark delay are dropped."""
    keyed = stream.withColumn("round", F.to_date("ts"))
    return (
        keyed.withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["user_id", "round"])
        .select(F.col("user_id").alias("entity"), "round")
    )


def entity_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """``(entity, at, norm)``: one row per entity and closed window."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.col("user_id").alias("entity"))
        .agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        .select("entity", F.window_time("window").alias("at"), "norm")
    )


def mean_partials(batch: DataFrame) -> DataFrame:
    """``(group, idx, wv, w)`` of ``(group, vector, weight)``: what a running mean needs."""
    return to_long(batch, ["group", "weight"]).groupBy("group", "idx").agg(
        F.sum(F.col("val") * F.col("weight")).alias("wv"), F.sum("weight").alias("w")
    )


def running_mean(partials: DataFrame) -> DataFrame:
    """``(group, idx, val, version)``: weighted mean so far; the version counts merged batches."""
    mean = F.when(F.sum("w") != 0, F.sum("wv") / F.sum("w"))
    return partials.groupBy("group", "idx").agg(
        mean.alias("val"), F.countDistinct("batch_id").cast("int").alias("version")
    )


def fold_partials(batch: DataFrame, cols: list[str]) -> DataFrame:
    """Per entity and column, the last value that is not null together with its place in time."""
    place = F.struct("ts", "event_id")
    return batch.groupBy("entity").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(place.alias("place"), F.col(c).alias("value"))))
        .alias(c) for c in cols
    ])


def latest_state(partials: DataFrame, cols: list[str]) -> DataFrame:
    return partials.groupBy("entity").agg(*[F.max(c)["value"].alias(c) for c in cols])
