"""Structured Streaming: event intake, metric counters, recent failures, last-seen times, stale entities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


def intake(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Events with repeats of a key within the delay dropped (of a batch: all repeats)."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if timed.isStreaming else timed.dropDuplicates([key])


def counters(stream: DataFrame, at: str, metric: str, value: str, span: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Sums and counts of each metric in tumbling or sliding windows."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, span, slide), metric).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def last_seen(stream: DataFrame, entity: str, at: str) -> DataFrame:
    """Latest time of each entity; late rows cannot move it back."""
    return stream.groupBy(entity).agg(F.max(F.col(at).cast("timestamp")).alias("last_at"))


class Recent(StatefulProcessor):
    """The latest N (sequence, detail) of each component, kept in list state."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("seq", LongType()), StructField("detail", StringType())])
        self.rows = handle.getListState("rows", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = [(int(s), d) for s, d in self.rows.get()] if self.rows.exists() else []
        for frame in rows:
            kept += [(int(s), d) for s, d in zip(frame["seq"], frame["detail"])]
            kept = sorted(set(kept), reverse=True)[: self.n]
        self.rows.put(kept)
        yield pd.DataFrame({"component": [key[0]] * len(kept), "seq": [s for s, _ in kept], "detail": [d for _, d in kept]})

    def close(self) -> None:
        pass


def recent(stream: DataFrame, n: int) -> DataFrame:
    """component, seq, detail: after each batch, the latest n rows of the components it touched."""
    return stream.select("component", "seq", "detail").groupBy("component").transformWithStateInPandas(
        statefulProcessor=Recent(n), outputStructType="component string, seq long, detail string", outputMode="Update", timeMode="None"
    )


class Stale(StatefulProcessor):
    """The last time of each entity, and an event-time timer a span later. A row that comes late moves neither; a later
    one moves both, so each silence is told once, when the watermark passes its end."""

    def __init__(self, span_ms: int) -> None:
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        newest = max(int(frame["at_us"].max()) for frame in rows)
        before, silent = self.last.get()[0] if self.last.exists() else None, []
        if before is None or newest > before:
            if before is not None:
                if self.due(before) <= timer_values.getCurrentWatermarkInMs():
                    silent = [before]  # its timer would fire after these rows
                self.handle.deleteTimer(self.due(before))
            self.last.update((newest,))
            self.handle.registerTimer(self.due(newest))
        yield self.told(key[0], silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.told(key[0], [self.last.get()[0]])

    @staticmethod
    def told(entity: str, last_us: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"entity": pd.Series([entity] * len(last_us), dtype="object"), "last_us": pd.Series(last_us, dtype="int64")})

    def due(self, at_us: int) -> int:
        return -(-at_us // 1000) + self.span

    def close(self) -> None:
        pass


def stale_entities(stream: DataFrame, entity: str, at: str, days: int, delay: str = "1 hour") -> DataFrame:
    """entity, last_at, stale_at of every entity that was not seen for days, told once the watermark (the latest time less
    delay) passes stale_at; a row each time it falls silent. Rows without entity or time are left out. Needs the RocksDB
    state store.

    Only the latest time of an entity in each Arrow batch goes into the shuffle, so a busy entity is a few rows."""

    def latest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby("entity", as_index=False)["at"].max()

    rows = stream.select(F.col(entity).cast("string").alias("entity"), F.col(at).cast("timestamp").alias("at")).filter("entity IS NOT NULL AND at IS NOT NULL")
    newest = rows.mapInPandas(latest, "entity string, at timestamp").withWatermark("at", delay)
    told = newest.withColumn("at_us", F.unix_micros("at")).groupBy("entity").transformWithStateInPandas(
        statefulProcessor=Stale(days * 86_400_000), outputStructType="entity string, last_us long", outputMode="Append", timeMode="EventTime"
    )
    last = F.timestamp_micros("last_us")
    return told.select(F.col("entity").alias(entity), last.alias("last_at"), (last + F.make_dt_interval(F.lit(days))).alias("stale_at"))
