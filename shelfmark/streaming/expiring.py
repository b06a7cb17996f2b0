"""Promotion by keyed state that expires: a skill that rests is forgotten, and its state goes with it.

State is kept by key in RocksDB, so it is bounded by what is in use and not by all skills that ever were. Event time decides:
a timer of each skill goes off when the watermark passes its last use by `rest`; so the outcome is the same after a restart
and, for uses no later than the watermark allows, the same as that of `promotions` below over the whole ledger at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfmark.schema import PROMOTE_AT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROMOTED = "skill string, uses bigint, since timestamp, at timestamp"


class Promotions(StatefulProcessor):
    """Of each skill the uses since it last rested, and the times of those that count towards a promotion."""

    def __init__(self, threshold: int, rest_ms: int, pinned: tuple[str, ...]) -> None:
        self.threshold, self.rest_ms, self.pinned = threshold, rest_ms, pinned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getValueState("uses", "n bigint, last bigint")
        self.times = handle.getListState("times", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.uses.get() if self.uses.exists() else (0, None)
        times = [t for (t,) in self.times.get()] if n else []
        out, before = [], last
        for ms in sorted(int(t.value // 1_000_000) for frame in rows for t in frame["ts"]):
            if last is not None and ms - last > self.rest_ms:
                n, times = 0, []
            n, last = n + 1, ms if last is None else max(last, ms)
            if n <= self.threshold:
                times.append(ms)
            if n == self.threshold and key[0] not in self.pinned:
                out.append((key[0], n, min(times), ms))
        self.uses.update((n, last))
        self.times.put([(t,) for t in times])
        if before is not None:
            self.handle.deleteTimer(before + self.rest_ms + 1)
        self.handle.registerTimer(last + self.rest_ms + 1)
        if out:
            when = lambda i: pd.to_datetime([r[i] for r in out], unit="ms")
            yield pd.DataFrame({"skill": pd.Series([r[0] for r in out], dtype=object), "uses": [r[1] for r in out], "since": when(2), "at": when(3)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.uses.clear()
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Keyed state with timers needs the session's streams to keep state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def promoted(events: DataFrame, rest: int, late: str = "0 seconds", pinned: tuple[str, ...] = (), threshold: int = PROMOTE_AT) -> DataFrame:
    """skill, uses, since, at of a stream of hits: once for each time that a skill, after a rest of more than `rest` seconds, is used `threshold` times."""
    prepare(events.sparkSession)
    used = _used(events).withWatermark("ts", late)
    return used.groupBy("skill").transformWithStateInPandas(Promotions(threshold, rest * 1000, pinned), PROMOTED, "append", "EventTime")


def _used(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin("adopt", "chat") & F.col("skill").isNotNull()).select("skill", "ts")


def promotions(events: DataFrame, rest: int, pinned: tuple[str, ...] = (), threshold: int = PROMOTE_AT) -> DataFrame:
    """The same of a whole ledger."""
    ms = F.floor(F.unix_micros("ts") / 1000)
    rows, of = _used(events).withColumn("ms", ms), Window.partitionBy("skill").orderBy("ms")
    rows = rows.withColumn("fresh", F.coalesce(F.col("ms") - F.lag("ms").over(of) > rest * 1000, F.lit(True)).cast("int"))
    rows = rows.withColumn("round", F.sum("fresh").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("skill", "round").orderBy("ms")
    rows = rows.withColumn("n", F.row_number().over(within)).withColumn("first", F.min("ms").over(within))
    at = rows.filter((F.col("n") == threshold) & ~F.col("skill").isin(list(pinned)))
    return at.select("skill", F.col("n").cast("bigint").alias("uses"), F.timestamp_millis("first").alias("since"), F.timestamp_millis("ms").alias("at"))
