"""Event windows with watermarks, throttled hints with state, and incremental refresh, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.dense import Encoder, refresh_store
from quarry.sources.records import append_store, read_store


def read_events(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_trigger).load(path)


def event_windows(events: DataFrame, width: str, late: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in event-time windows; windows close once the watermark passes, later events are dropped. ts: timestamp."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def idle_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that a pause ends."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


def throttled(prompts: DataFrame, key: str, cooldown_minutes: int = 10) -> DataFrame:
    """Prompts that get a hint, none within the cooldown after the last hint given; the state is that hint's time for each key. prompts: key (long), ts, event_id."""
    step = cooldown_minutes * 60_000_000

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        out = []
        for t, event in zip(rows["micros"], rows["event_id"], strict=True):
            if last is None or t - last >= step:
                last = int(t)
                out.append(int(event))
        state.update((last,))
        yield pd.DataFrame({"key": [name[0]] * len(out), "event_id": out})

    timed = prompts.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").cast("long").alias("event_id"))
    return timed.groupBy("key").applyInPandasWithState(run, "key long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def hints(events: DataFrame, key: str, quiet_minutes: int = 15, cooldown_minutes: int = 10, ttl: str | None = None) -> DataFrame:
    """Prompts that get a hint, on a stream of prompts and calls: none within quiet_minutes after a call of the key, none within the cooldown after the last hint.

    events: key (long), ts, event_id, is_call; prompts that want no hint are filtered before. The state of a key is the times of its last call and last hint;
    with `ttl` milliseconds (as text) it is forgotten once no event came for so long
    (such a query runs until stopped: Spark always sees another batch coming, `availableNow` included). A call counts before a prompt of the same time.
    """
    quiet, step = quiet_minutes * 60_000_000, cooldown_minutes * 60_000_000

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        called, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["micros", "is_call", "event_id"], ascending=[True, False, True])
        out = []
        for t, event, is_call in zip(rows["micros"], rows["event_id"], rows["is_call"], strict=True):
            if is_call:
                called = int(t)
            elif (called is None or t - called >= quiet) and (last is None or t - last >= step):
                last = int(t)
                out.append(int(event))
        state.update((called, last))
        if ttl is not None:
            state.setTimeoutDuration(int(ttl))
        yield pd.DataFrame({"key": [name[0]] * len(out), "event_id": out})

    timed = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").cast("long").alias("event_id"), "is_call")
    forget = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    return timed.groupBy("key").applyInPandasWithState(run, "key long, event_id long", "called long, last long", "append", forget)


def refresh(chunks: DataFrame, store: str, checkpoint: str, encoder: Encoder | None = None):
    """Embed what new chunk files bring and the store lacks, then stop: a streaming query to wait for. Replays append nothing new."""

    def step(batch: DataFrame, _: int) -> None:
        append_store(refresh_store(batch, read_store(batch.sparkSession, store), encoder), store)

    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
