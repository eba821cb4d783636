"""Streaming operators: rate limiting, job state, windowed counts, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planlake.streaming import job_state

MINUTE, HOUR = 60_000_000, 3_600_000_000


def admit(times: list[int], kept: list[int], per_minute: int, per_hour: int) -> tuple[list[bool], list[int]]:
    """Decide requests of one key in time order (microseconds). ``kept`` are earlier admitted times.

    A request is rejected when the trailing window already holds the limit; rejected requests don't count. At
    most ``per_hour`` times are kept, so the state is bounded whatever the traffic.
    """
    out, hour_from, minute_from = [], 0, 0
    for t in times:
        while hour_from < len(kept) and t - kept[hour_from] >= HOUR:
            hour_from += 1
        minute_from = max(minute_from, hour_from)
        while minute_from < len(kept) and t - kept[minute_from] >= MINUTE:
            minute_from += 1
        ok = len(kept) - hour_from < per_hour and len(kept) - minute_from < per_minute
        out.append(ok)
        if ok:
            kept.append(t)
    return out, kept[hour_from:]


def busy_parts(rows: DataFrame) -> DataFrame:
    """(key, us, ...) rows + part: a new part of a key begins after an idle hour, when none of its earlier requests counts any more.

    A gap of an hour never lies inside one clock hour, so it is looked for between a key's clock hours, of which only the first and
    last time are windowed; a hot key's rows are met by clock hour.
    """
    rows = rows.withColumn("__hour", F.floor(F.col("us") / HOUR))
    hours = rows.groupBy("key", "__hour").agg(F.min("us").alias("__first"), F.max("us").alias("__last"))
    w = Window.partitionBy("key").orderBy("__hour")
    new = F.coalesce(F.col("__first") - F.lag("__last").over(w) >= HOUR, F.lit(False))
    parts = hours.withColumn("__new", new).withColumn("part", F.sum(F.col("__new").cast("long")).over(w))
    return rows.join(parts.select("key", "__hour", "part"), ["key", "__hour"]).drop("__hour")


def rate_limit_batch(events: DataFrame, per_minute: int = 60, per_hour: int = 1000) -> DataFrame:
    """I1 on a table (event_id, key, us): + admitted. A key's requests are parted at idle hours, and parts are spread over tasks, so a
    hot key meets in one task only as far as it is never idle. The rows of a part are read in time order as a stream of batches,
    so none is ever held whole. Rows without a key or a time can't be charged to anyone and are admitted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = object(), []
        for frame in frames:
            flags: list[bool] = []
            for part, rows in frame.groupby(["key", "part"], sort=False):
                if part != last:
                    last, kept = part, []
                got, kept = admit(rows["us"].tolist(), kept, per_minute, per_hour)
                flags += got
            yield frame[["event_id", "key", "us"]].assign(admitted=flags)

    rows = events.select("event_id", F.col("key").cast("long").alias("key"), F.col("us").cast("long").alias("us"))
    free = rows.where("key IS NULL OR us IS NULL").withColumn("admitted", F.lit(True))
    rows = busy_parts(rows.where("key IS NOT NULL AND us IS NOT NULL")).select("event_id", "key", "us", "part")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "us", "event_id")
    return rows.mapInPandas(run, "event_id long, key long, us long, admitted boolean").unionByName(free)


def rate_limit_stream(events: DataFrame, per_minute: int = 60, per_hour: int = 1000) -> DataFrame:
    """I1 on a stream (event_id, key, us): the state of a key is its admitted times of the last hour, dropped after an idle hour."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["us", "event_id"])
        flags, kept = admit(frame["us"].tolist(), kept, per_minute, per_hour)
        state.update((kept,))
        state.setTimeoutDuration(3_600_000)
        yield frame[["event_id", "key", "us"]].assign(admitted=flags)

    return events.groupBy("key").applyInPandasWithState(run, "event_id long, key long, us long, admitted boolean", "kept array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def request_rate(events: DataFrame) -> DataFrame:
    """Requests of the key in the trailing minute and hour, the row included.

    Windows run over clock hours of a key: each row is also written to the next hour, as context that isn't returned, since no
    trailing hour reaches further back. So a hot key is spread over its hours. Rows without a time are counted among themselves.
    """
    hour = F.floor(F.col("us") / HOUR)
    place = lambda h, own: F.struct(h.alias("hour"), F.lit(own).alias("own"))
    copies = F.when(F.col("us").isNull(), F.array(place(hour, True))).otherwise(F.array(place(hour, True), place(hour + 1, False)))
    rows = events.withColumn("__at", F.explode(copies))
    w = Window.partitionBy("key", "__at.hour").orderBy("us")
    rows = rows.withColumn("minute", F.count("*").over(w.rangeBetween(-MINUTE + 1, 0))).withColumn("hour", F.count("*").over(w.rangeBetween(-HOUR + 1, 0)))
    return rows.where("__at.own").drop("__at")


def job_state_stream(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", buckets: int = 64, parts: int = 16):
    """Keeps the latest state of each job in the table at ``path``, read by ``job_state.read``; replays change nothing."""
    deduped = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    merge = lambda batch, number: job_state.upsert(batch, path, number, buckets, parts)
    return deduped.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", watermark: bool = True) -> DataFrame:
    """I4: counts by class in tumbling or sliding windows; rows later than the watermark are dropped on a stream."""
    e = events.withWatermark("ts", late) if watermark else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", watermark: bool = True) -> DataFrame:
    """Sessions of a user, closed by a gap."""
    e = events.withWatermark("ts", late) if watermark else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def clean_stream(detections: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stateless steps of the batch chain, on a stream."""
    for step in steps:
        detections = detections.transform(step)
    return detections
