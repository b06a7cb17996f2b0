"""Ledgers as streams: counts, windows over event time, and promotion by keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.schema import HEARTBEAT, HIT_EVENT, PROMOTE_AT, RECENT_EVENTS, USAGE_EVENT


def hit_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of hit events that arrive as files; lines that don't parse are dropped."""
    return spark.readStream.schema(HIT_EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def usage_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(USAGE_EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window and kind; what is later than the watermark allows is dropped, and state goes with it."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_hits") == 0, 1).otherwise(0)).alias("zero")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "kind", "n", "zero")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent").agg(F.count("*").alias("n")).select("agent", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def usage(events: DataFrame) -> DataFrame:
    return events.groupBy("cmd").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"))


def promotions(events: DataFrame, pinned: tuple[str, ...] = (), threshold: int = PROMOTE_AT) -> DataFrame:
    """skill, uses: once for each skill, in the batch in which its explicit uses reach the threshold, unless it is pinned."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uses, told = state.get if state.exists else (0, False)
        uses += sum(len(f) for f in frames)
        due = uses >= threshold and not told and key[0] not in pinned
        state.update((uses, told or due))
        if due:
            yield pd.DataFrame({"skill": [key[0]], "uses": [uses]})

    used = events.filter(F.col("kind").isin("adopt", "chat") & F.col("skill").isNotNull()).select("skill")
    return used.groupBy("skill").applyInPandasWithState(count, "skill string, uses bigint", "uses bigint, told boolean", "append", GroupStateTimeout.NoTimeout)


def gate(fingerprint: str, last: str | None, idle: float, interactions: int, interval: float = HEARTBEAT, force: bool = False) -> tuple[bool, str]:
    """Whether to refresh, and why: another fingerprint than the last (changed); none so far only sets one (first); more than
    `interval` seconds since the last refresh, with interactions since (due); on demand (forced); else fresh."""
    if last and fingerprint != last:
        return True, "changed"
    if not last:
        return False, "first"
    if idle > interval and interactions > 0:
        return True, "due"
    return (True, "forced") if force else (False, "fresh")


def refresh_on_change(events: DataFrame, fingerprint, refresh, checkpoint: str, every: str = f"{HEARTBEAT} seconds", interval: float = HEARTBEAT, keep: int = RECENT_EVENTS, forced=lambda: False):
    """Start a heartbeat: every interval, call refresh(batch, number) if the gate opens for fingerprint(spark).

    What the gate goes by stands in the folder `<checkpoint>-gate`, one row a beat, the newest two of which stay, with the
    newest `keep` events in `<checkpoint>-recent`; so a query that is started again goes on from there, and a beat that is
    repeated after a failure finds the state that it found before. Times are those of the driver's clock.
    """
    state, recent = f"{checkpoint}-gate", f"{checkpoint}-recent"

    def beat(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, time.time()
        batch = batch.persist()
        before = _before(spark, state, number)
        found = before.first() if before is not None else None
        last, checked, seen = (found["fingerprint"], found["checked"], found["interactions"]) if found else (None, now, 0)
        current, seen = fingerprint(spark), seen + batch.count()
        go, reason = gate(current, last, now - checked, seen, interval, forced())
        if go:
            refresh(batch, number)
            checked, seen = now, 0
        old = _before(spark, recent, number)
        newest = batch if old is None else old.unionByName(batch)
        newest.orderBy(F.col("ts").desc()).limit(keep).write.mode("overwrite").parquet(f"{recent}/beat={number}")
        spark.createDataFrame([(current, checked, seen, reason)], "fingerprint string, checked double, interactions bigint, reason string").write.mode("overwrite").parquet(f"{state}/beat={number}")
        for place in (state, recent):
            _deleted(spark, f"{place}/beat={number - 2}")
        batch.unpersist()

    return events.writeStream.foreachBatch(beat).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _before(spark: SparkSession, place: str, number: int) -> DataFrame | None:
    """What the beat before this one wrote."""
    where = f"{place}/beat={number - 1}"
    return spark.read.parquet(where) if _path(spark, where)[0].exists(_path(spark, where)[1]) else None


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _deleted(spark: SparkSession, where: str) -> None:
    files, path = _path(spark, where)
    files.delete(path, True)
