"""Structured Streaming over the events table, and the same windows in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    w = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    w = events.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    w = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def stream(spark: SparkSession, path: str, late: str = "2 days") -> DataFrame:
    """The events as a stream of parquet files with a watermark."""
    return spark.readStream.schema(SCHEMA).parquet(path).withWatermark("ts", late)


def drain(df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Run a stream over all files that are there, into a table; returns the table."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def finished(df: DataFrame, at: str) -> DataFrame:
    """Run an aggregation over all files that are there; the table of its last state."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def updates(df: DataFrame, at: str) -> DataFrame:
    """Run an aggregation over all files that are there; every row that a batch updated, each batch once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={epoch}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out").select(*df.columns)


def by_id(column: str) -> WindowSpec:
    """Order of one narrow column over all rows, for positions that strides are taken at."""
    return Window.orderBy(column)


def append_feedback(df: DataFrame, at: str) -> None:
    """Append each micro-batch of votes once: a batch id is a folder of its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/votes/batch={epoch}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def counted(events: DataFrame) -> DataFrame:
    """Stateful running count per user."""
    import pandas as pd

    def step(key, pdfs, state):
        n = state.get[0] if state.exists else 0
        n += sum(len(p) for p in pdfs)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long", "n long", "update", "NoTimeout")
