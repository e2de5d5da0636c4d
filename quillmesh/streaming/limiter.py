"""Stateful and streaming operators: the sliding-window limiter, hourly counts and the incremental import."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept(times: list[float], limit: int, window: float, state: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which hits of one key are let through: at most `limit` accepted ones in the last `window` seconds. Rejected hits
    aren't recorded, a hit exactly `window` old is gone."""
    kept = deque(state or ())
    out = []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.popleft()
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out, list(kept)


def limit_batch(events: DataFrame, key: str = "user_id", limit: int = 60, window: float = 60.0, before: DataFrame | None = None) -> DataFrame:
    """(event_id, key, ts, accepted). A key's events are walked in order of time, since acceptance feeds back: one pass over
    rows partitioned by key and sorted, with at most `limit` times of one key in memory. before: accepted events of
    earlier batches (event_id, key, ts), which count and don't come out again."""
    pick = lambda df, old: df.select("event_id", F.col(key).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(old).alias("old"))
    rows = pick(events, False) if before is None else pick(events, False).unionByName(pick(before, True))
    rows = rows.repartition("k").sortWithinPartitions("k", "us", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept, span = None, deque(), int(window * 1e6)
        for pdf in batches:
            flags = []
            for k, us, old in zip(pdf["k"].tolist(), pdf["us"].tolist(), pdf["old"].tolist(), strict=True):
                if k != last:
                    last = k
                    kept.clear()
                while kept and kept[0] <= us - span:
                    kept.popleft()
                ok = old or len(kept) < limit
                if ok:
                    kept.append(us)
                flags.append(ok)
            out = pd.DataFrame({"event_id": pdf["event_id"], key: pdf["k"], "us": pdf["us"], "accepted": flags})
            yield out[~pdf["old"]]

    walked = rows.mapInPandas(run, f"event_id long, {key} long, us long, accepted boolean")
    return walked.select("event_id", key, F.timestamp_micros("us").alias("ts"), "accepted")


def limit_stream(events: DataFrame, key: str = "user_id", limit: int = 60, window: float = 60.0, late: str = "1 hour") -> DataFrame:
    """(event_id, key, ts, accepted) of a stream: the limiter with each key's accepted times, at most `limit` of them, as state.

    The events of a key that one micro-batch brings are walked in order of time; events later than `late` are dropped, and so
    is the state of a key once its last accepted time can't count any more.
    """
    span = int(window * 1e6)

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        flags = []
        for us in rows["us"].tolist():
            while kept and kept[0] <= us - span:
                kept.popleft()
            flags.append(len(kept) < limit)
            if flags[-1]:
                kept.append(us)
        state.update((list(kept),))
        state.setTimeoutTimestamp(max(kept[-1] // 1000 + int(window * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"], key: of[0], "us": rows["us"], "accepted": flags})

    at = F.col("ts").cast("timestamp")
    rows = events.select("event_id", F.col(key).alias("k"), F.unix_micros(at).alias("us"), at.alias("at")).withWatermark("at", late)
    decided = rows.groupBy("k").applyInPandasWithState(step, f"event_id long, {key} long, us long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return decided.select("event_id", key, F.timestamp_micros("us").alias("ts"), "accepted")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n, total): counts by hour; works on a table and, with a watermark, on a stream."""
    e = events.withColumn("t", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("t", late)
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def import_stream(snapshots: DataFrame, read_existing, write_next, at):
    """Re-imports every micro-batch: diff against what read_existing() gives, write_next(next version, changes)."""
    from quillmesh.operators.ingest import apply_snapshot, change_set

    def batch(df: DataFrame, _: int) -> None:
        existing = read_existing()
        write_next(apply_snapshot(df, existing, at), change_set(df, existing))

    return snapshots.writeStream.foreachBatch(batch)
