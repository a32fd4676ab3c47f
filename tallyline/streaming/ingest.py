"""The same results from streams: file ingest without repeats, running volumes, ratings kept in state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, files: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of these names that come into a folder, with ts as event time."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files)
    return read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """The first row of each key, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def volumes(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows and values by event type and window."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "60 days", late: str = "1 day") -> DataFrame:
    """Runs of a user's rows without a longer gap."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rolling_rates(stream: DataFrame) -> DataFrame:
    """Each player's contests and wins so far, kept in state and given out per batch; stream: player, won."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, wins = state.get if state.exists else (0, 0)
        for batch in batches:
            n, wins = n + len(batch), wins + int(batch["won"].sum())
        state.update((n, wins))
        yield pd.DataFrame({"player": [key[0]], "matches": [n], "wins": [wins]})

    return stream.groupBy("player").applyInPandasWithState(update, "player long, matches long, wins long", "matches long, wins long", "update", "NoTimeout")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet, and read the result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
