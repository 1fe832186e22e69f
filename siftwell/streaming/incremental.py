"""Incremental work: new rows only, merged sets, windows of requests, streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def new_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet, by key and not by position."""
    return source.join(done.select(F.col(key).alias("_done")), F.col(key) == F.col("_done"), "left_anti")


def retried(done: DataFrame, words: str = "word_count") -> DataFrame:
    """What counts as done: rows with words; the others are taken again."""
    return done.where(F.col(words) > 0)


def merged_sets(old: DataFrame, new: DataFrame, key: str, values: str) -> DataFrame:
    """Each key's set of values in both, sorted."""
    both = old.select(key, F.explode(values).alias("v")).unionByName(new.select(key, F.explode(values).alias("v")))
    return both.distinct().groupBy(key).agg(F.array_sort(F.collect_list("v")).alias(values))


def request_windows(events: DataFrame, time: str, client: str, width: str = "1 minute") -> DataFrame:
    """(window_start, client, n) of each tumbling window."""
    return events.groupBy(F.window(time, width), client).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), client, "n")


def over_limit(events: DataFrame, time: str, client: str, most: int = 20, width: str = "1 minute") -> DataFrame:
    return request_windows(events, time, client, width).where(F.col("n") > most)


def admitted(events: DataFrame, time: str, client: str, key: str, most: int = 20, width: str = "1 minute") -> DataFrame:
    """events with admitted: true for the first most of each client in each tumbling window, by time and key."""
    order = Window.partitionBy(client, F.window(time, width)).orderBy(time, key)
    return events.withColumn("admitted", F.row_number().over(order) <= most)


def stream_admission(events: DataFrame, time: str, client: str, key: str, most: int = 20, seconds: int = 60, late: str = LATE) -> DataFrame:
    """(client, key, time, admitted) of a stream: of each client's requests in a window the first most to come are let through.

    The state of a client is a count for each window that may still get requests;
    windows go when the watermark has passed their end, by a timer if no request
    comes. Requests behind the watermark are dropped. Those of one batch are taken
    by time and key, so that a batch of all rows gives what admitted gives.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (client, key, time)}

    def admit(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get)) if state.exists else {}
        rows = [] if state.hasTimedOut else list(frames)
        if rows:
            own = pd.concat(rows).sort_values([time, key], kind="stable")
            window = own[time].to_numpy().astype("datetime64[s]").astype("int64") // seconds
            place = own.groupby(window).cumcount().to_numpy() + pd.Series(window).map(counts).fillna(0).to_numpy(dtype="int64")
            for w, n in zip(*np.unique(window, return_counts=True)):
                counts[int(w)] = counts.get(int(w), 0) + int(n)
            yield own[[client, key, time]].assign(admitted=place < most)
        passed = state.getCurrentWatermarkMs()
        counts = {w: n for w, n in counts.items() if (w + 1) * seconds * 1000 > passed}
        if counts:
            state.update((list(counts), list(counts.values())))
            state.setTimeoutTimestamp(max((min(counts) + 1) * seconds * 1000, passed + 1))
        elif state.exists:
            state.remove()

    watched = events.withWatermark(time, late).select(client, key, time).groupBy(client)
    out = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", admitted boolean"
    return watched.applyInPandasWithState(admit, out, "windows array<bigint>, counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def first_events(events: DataFrame, key: str, time: str) -> DataFrame:
    """The first event of each key: the batch form of the stream below."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(time))).where("_n = 1").drop("_n")


def stream_tables(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_dedupe(events: DataFrame, key: str, time: str, late: str = LATE) -> DataFrame:
    """Each key once, as far back as events may be late; state beyond is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_windows(events: DataFrame, time: str, client: str, width: str = "1 minute", late: str = LATE) -> DataFrame:
    return request_windows(events.withWatermark(time, late), time, client, width)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Handles what is there now, batch by batch, and stops; a later run goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
