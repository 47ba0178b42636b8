"""The event journal: session summaries, last events, as-of joins, throttled hints, usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HINT_CHARS, QUIET_MIN, COOLDOWN_MIN = 200, 15, 10


def last_event(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key, all columns."""
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in events.columns if c not in order and c not in keys])
    return events.groupBy(*keys).agg(F.max(whole).alias("e")).select(*keys, "e.*")


def of_roots(events: DataFrame, roots: DataFrame, key: str = "root") -> DataFrame:
    """The events whose root is one of `roots` (column root), however either is capitalised."""
    return events.join(roots.select(F.lower("root").alias("_root")).distinct(), F.lower(F.col(key).cast("string")) == F.col("_root"), "left_semi")


def since_last_start(events: DataFrame, key: str = "root", kind: str = "event", ts: str = "ts") -> DataFrame:
    """Each event joined to its key's last start at or before it: adds started and, since then, the event's number."""
    own = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("started", F.last(F.when(F.col(kind) == "start", F.col(ts)), ignorenulls=True).over(own))
    held = held.withColumn("_run", F.count_if(F.col(kind) == "start").over(own))
    number = F.row_number().over(Window.partitionBy(key, "_run").orderBy(ts, "event_id"))
    return held.withColumn("number", number).drop("_run")


def status(events: DataFrame, key: str = "root") -> DataFrame:
    """Of each key the session since its last start: start, calls, errors, the last three error ids; and its history of starts and failures."""
    last = events.groupBy(key).agg(F.max(F.when(F.col("event") == "start", F.col("ts"))).alias("start"), F.count_if(F.col("event") == "start").alias("starts"), F.count_if(F.col("event") == "build_failed").alias("failures"))
    now = events.join(last.select(key, "start"), key).where((F.col("ts") >= F.col("start")) & (F.col("event") != "start"))
    errors = F.collect_list(F.when(F.col("event") == "build_failed", F.struct("ts", "event_id")))
    s = now.groupBy(key).agg(F.count_if(F.col("event") == "call").alias("calls"), F.count_if(F.col("event") == "build_failed").alias("errors"), F.transform(F.slice(F.sort_array(errors, asc=False), 1, 3), lambda x: x["event_id"]).alias("last_errors"))
    return last.join(s, key, "left").select(key, "start", "starts", "failures", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("last_errors", F.array().cast("array<bigint>")).alias("last_errors"))


def gaps(events: DataFrame, key: str, minutes: int) -> DataFrame:
    """Events that follow a pause of at least `minutes`, and each key's first."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    held = events.withColumn("before", before)
    return held.where(F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr(f"INTERVAL {minutes} MINUTES")))


def idle_sessions(events: DataFrame, key: str, minutes: int = 30) -> DataFrame:
    """Sessions that end after an idle time: key, first, last, n."""
    own = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.col("_b").isNull() | (F.col("ts") >= F.col("_b") + F.expr(f"INTERVAL {minutes} MINUTES"))
    held = events.withColumn("_b", F.lag("ts").over(own)).withColumn("_s", F.sum(new.cast("int")).over(own))
    return held.groupBy(key, "_s").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("_s")


def wants_hint(prompt: Column) -> Column:
    """Long enough and not a command."""
    return (F.length(prompt) >= HINT_CHARS) & ~F.ltrim(prompt).startswith("/")


def throttled(prompts: DataFrame, key: str, quiet: DataFrame | None = None, quiet_minutes: int = QUIET_MIN, cooldown_minutes: int = COOLDOWN_MIN) -> DataFrame:
    """Prompts that get a hint: none within quiet_minutes after a call of the key, none within cooldown_minutes after the last hint given.

    The second rule depends on the hints given so far, so each key is one ordered fold over times in microseconds; a suppressed prompt
    doesn't reset it. prompts: key, ts, event_id; quiet: key, ts of calls.
    """
    p = prompts.select(key, "ts", "event_id", F.lit(0).alias("is_call"))
    if quiet is not None:
        p = p.unionByName(quiet.select(key, "ts", F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("is_call")))
        own = Window.partitionBy(key).orderBy("ts", F.desc("is_call")).rowsBetween(Window.unboundedPreceding, 0)
        p = p.withColumn("called", F.last(F.when(F.col("is_call") == 1, F.col("ts")), ignorenulls=True).over(own)).where("is_call = 0")
        p = p.where(F.col("called").isNull() | (F.col("ts") >= F.col("called") + F.expr(f"INTERVAL {quiet_minutes} MINUTES")))
    step = cooldown_minutes * 60_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(micros.alias("t"), F.col("event_id").alias("id")))).alias("all"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("got"))

    def take(s: Column, x: Column) -> Column:
        free = s["last"].isNull() | (x["t"] - s["last"] >= step)
        return F.struct(F.when(free, x["t"]).otherwise(s["last"]).alias("last"), F.when(free, F.concat(s["got"], F.array(x["id"]))).otherwise(s["got"]).alias("got"))

    return rows.select(key, F.explode(F.aggregate("all", start, take, lambda s: s["got"])).alias("event_id"))


def usage(calls: DataFrame, edits: DataFrame) -> DataFrame:
    """Of each call the files it showed, in order, and those edited later: session, call, shown, used.

    calls: session, call, n (order in the session), shown (array); edits: session, n, path.
    """
    shown = calls.select("session", "call", "n", F.posexplode(F.array_distinct("shown")).alias("at", "path"))
    last = edits.groupBy("session", "path").agg(F.max("n").alias("edited"))
    held = shown.join(last, ["session", "path"], "left").withColumn("used", F.coalesce(F.col("edited") > F.col("n"), F.lit(False)))
    items = F.array_sort(F.collect_list(F.struct("at", "path", "used")))
    got = held.groupBy("session", "call").agg(items.alias("x"))
    return got.select("session", "call", F.transform("x", lambda i: i["path"]).alias("shown"), F.transform(F.filter("x", lambda i: i["used"]), lambda i: i["path"]).alias("used"))


def windows(events: DataFrame, width: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of value in event-time windows; the same on a stream with a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def to_pandas(df: DataFrame, most: int = 1000) -> pd.DataFrame:
    """At most `most` rows, for display."""
    return df.limit(most).toPandas()
