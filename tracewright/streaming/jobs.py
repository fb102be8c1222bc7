"""Structured Streaming: bounded replays of a table, windows with a watermark, state across batches.

Every job here ends by itself (availableNow) and goes on where it stopped if its checkpoint folder is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.session import work_folder


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; its time column, which has no zone, is taken as UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", False).parquet(folder)
    return d.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in d.columns else d


def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now. In append mode the rows go to parquet; in update or complete mode each
    batch's rows are kept and the last state of a key is up to the reader (column batch_id). A checkpoint folder that is
    given is kept, and a later run goes on behind what was read."""
    out, own = out or work_folder(spark, name), checkpoint is None
    checkpoint = checkpoint or work_folder(spark, name + "-state")
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:

        def put(batch: DataFrame, n: int) -> None:
            """A batch that is run again replaces what it wrote before: each has a folder of its own."""
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}")

        q = w.outputMode(mode).foreachBatch(put).start()
    q.awaitTermination()
    if own:
        forget(spark, checkpoint)  # nobody can go on from it
    return spark.read.parquet(out)


def bounded_stream(df: DataFrame, keep: Column, most: int) -> DataFrame:
    """The first rows of a stream that pass, at most `most` over all its batches; a bound is required. The filter runs
    before the cut, and nothing is shuffled before it."""
    if most <= 0:
        raise ValueError("a bounded scan needs a positive bound")
    return df.where(keep).limit(most)


def forget(spark: SparkSession, *paths: str) -> None:
    """Removes folders of finished jobs (outputs and stream states) in whatever file system they are."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) by event time; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_coefficient(events: DataFrame, target: float, horizon: int, start: float) -> DataFrame:
    """(user_id, steps, coefficient) after each batch: a coefficient for each key that follows the batch's mean value,
    kept in the stream's state. A key's rows of a batch are folded as they come, in chunks."""

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, b = state.get if state.exists else (0, start)
        n, total = 0, 0.0
        for c in chunks:
            n += len(c)
            total += float(c["value"].sum())
        if n:
            b *= 1 + min(max(total / n / target - 1, -0.2), 0.2) * n / horizon
            steps += n
        state.update((steps, b))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [steps], "coefficient": [b]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, steps bigint, coefficient double", "steps bigint, coefficient double", "update", GroupStateTimeout.NoTimeout)
