"""Tracker state over a stream of frames, and results gathered batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "streak long, alive long, misses long, first long, confirmed boolean, removed boolean"
OUTPUT = "track_id long, frame long, streak long, alive long, is_confirmed boolean, is_removed boolean"


def step(state: tuple, frame: int, hit: bool, need: int = 3, delay: int = 15, unmatched: int = 8, low: int = -4, high: int = 8) -> tuple:
    """A track's state after one frame: streak, alive, misses, first, confirmed, removed."""
    streak, alive, misses, first, confirmed_, removed = state
    first = frame if first < 0 else first
    streak = streak + 1 if hit else 0
    alive = min(high, alive + 1) if hit else max(low, alive - 1)
    misses += not hit
    return streak, alive, misses, first, confirmed_ or streak >= need, removed or (misses >= unmatched and first > frame - delay)


NEW = (0, 0, 0, -1, False, False)


def tracker_stream(hits: DataFrame) -> DataFrame:
    """The states of all tracks over a stream of (track_id, frame, hit); frames of a track arrive in order between batches.

    State is a few numbers by track, kept by Spark's state store.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else NEW
        rows = sorted((int(f), bool(h)) for b in batches for f, h in zip(b["frame"], b["hit"], strict=True))
        out = []
        for frame, hit in rows:
            now = step(now, frame, hit)
            out.append((key[0], frame, now[0], now[1], now[4], now[5]))
        state.update(now)
        yield pd.DataFrame(out, columns=["track_id", "frame", "streak", "alive", "is_confirmed", "is_removed"])

    return hits.groupBy("track_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def accumulate(results: DataFrame, path: str, checkpoint: str):
    """Appends each batch of a stream to a table in `path` under its batch number: a batch that is tried again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def synced(spark, path: str) -> DataFrame:
    """All batches so far; a batch metric is a plain aggregation over it."""
    return spark.read.parquet(path).drop("batch")


def late_tolerant_counts(events: DataFrame, time: str, key: str, window: str, delay: str) -> DataFrame:
    """Counts by window and key; rows later than `delay` no longer count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
