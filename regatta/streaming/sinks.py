"""Running a stream to the end of what is there, and mergeable tables fed batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.operators.common import checkpoint_folder

# Time of the row that ends a log: after any event.
ENDED = "2200-01-01 00:00:00"


def new_folder(df: DataFrame, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(df)}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Append-mode run over all available input into a table; returns the table.

    Offsets and output live side by side, so running it again goes on where it stopped.
    """
    folder = folder or new_folder(stream, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_to_end(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], time: str = "ts", folder: str | None = None
) -> DataFrame:
    """As ``run_to_table(build(stream))`` for a log that has ended: its open windows are closed as well.

    A stream closes a window only when later rows push the watermark past it, so the last ones of a
    finished log would wait for ever. After all input is read, one row at ``ENDED`` with nothing but a time
    comes in by a second folder; the window of that row itself is never closed. Rows that come later are late.
    """
    folder = folder or new_folder(stream, "stream")
    spark, marks = stream.sparkSession, f"{folder}/end"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(marks)
    ended = stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks))
    run_to_table(build(ended), folder)
    last = spark.range(1).select(*[
        F.lit(ENDED if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields
    ])
    last.write.mode("append").parquet(marks)
    return run_to_table(build(ended), folder)


def run_partials(
    stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], folder: str | None = None
) -> DataFrame:
    """Write ``summarise(batch)`` to a ``batch_id`` partition per micro-batch; returns the table.

    A replayed batch overwrites its own partition, so every batch counts once. The summary is a
    grouped aggregate and combines map-side: a hot key costs one row per task and batch.
    """
    folder = folder or new_folder(stream, "partials")

    def merge(batch: DataFrame, batch_id: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")


def run_and_follow(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame] | None = None, time: str = "ts"
) -> DataFrame:
    """Run a stream into a table and return that table as the next stream.

    For state that must come after an aggregate, which one query cannot chain. With ``build`` the log
    has ended, as in ``run_to_end``.
    """
    folder = new_folder(stream, "stage")
    done = run_to_end(stream, build, time, folder) if build else run_to_table(stream, folder)
    return stream.sparkSession.readStream.schema(done.schema).parquet(f"{folder}/rows")
