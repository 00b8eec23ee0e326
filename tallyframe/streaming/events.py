"""Event time: windows with watermarks, sequences and state machines over unbounded input.

All functions take streaming and batch DataFrames alike, so a batch run is the oracle of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.functions.status import LIFECYCLE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def late(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def measures() -> list:
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


def windowed(df: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling (or sliding) window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = late(df, delay).groupBy(w.alias("w"), "event_type").agg(*measures())
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: events at most ``gap`` apart."""
    out = late(df, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(*measures())
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


SEQUENCED = "user_id long, event_id long, event_type string, sequence long"


def append_sequence(df: DataFrame) -> DataFrame:
    """Number of each event in its user's log, in order of arrival; keeps one counter per user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            frame["sequence"] = range(n + 1, n + 1 + len(frame))
            n += len(frame)
            yield frame[["user_id", "event_id", "event_type", "sequence"]]
        state.update((n,))

    return df.groupBy("user_id").applyInPandasWithState(step, SEQUENCED, "n long", "append", GroupStateTimeout.NoTimeout)


def run_states(df: DataFrame, key: str = "run_id", state_col: str = "state") -> DataFrame:
    """Accepted and refused transitions of a state machine: (key, state, previous, accepted); refused ones change nothing."""
    schema = f"{key} string, state string, previous string, accepted boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = []
        for frame in frames:
            for new in frame.sort_values(["ts", "event_id"])[state_col]:
                ok = new == "queued" if now is None else new in LIFECYCLE.get(now, [])
                rows.append((k[0], new, now, ok))
                now = new if ok else now
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(rows, columns=[key, "state", "previous", "accepted"])

    return df.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def interrupted(last_states: DataFrame) -> DataFrame:
    """Runs left running by a lost coordinator."""
    return last_states.where(F.col("state").isin("running", "cancel_requested")).withColumn("state", F.lit("interrupted"))
