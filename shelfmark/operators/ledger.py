"""Reports over the hit and usage ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.schema import CORRECTION_LINES, LEDGER_BYTES, LEDGER_KEEP, PROMOTE_AT
from shelfmark.sources.manifests import read_hits


def gaps(events: DataFrame, top: int = 10) -> DataFrame:
    """Queries of searches without hits, most frequent first."""
    return events.filter((F.col("kind") == "search") & (F.col("n_hits") == 0)).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query").limit(top)


def hits(events: DataFrame) -> DataFrame:
    """How often each name was among an event's hits; events carry `top`, or one skill."""
    names = F.transform("top", lambda t: t["name"]) if "top" in events.columns else F.array("skill")
    return events.filter((F.col("n_hits") > 0) & (F.col("kind") != "adopt")).select(F.explode(names).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


def adoptions(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'adopt'").groupBy("skill").agg(F.count("*").alias("n"))


def zombies(names: DataFrame, events: DataFrame) -> DataFrame:
    """name, pinned of those that no event hit, pinned ones first when ordered."""
    return names.join(hits(events).select(F.col("skill").alias("name")), "name", "left_anti")


def promotions(events: DataFrame, pinned: list[str] = (), threshold: int = PROMOTE_AT) -> DataFrame:
    """Skills in explicit use so often that they are due to be pinned, and are not."""
    used = events.filter(F.col("kind").isin("adopt", "chat")).groupBy("skill").agg(F.count("*").alias("uses")).filter(F.col("uses") >= threshold)
    return used.filter(~F.col("skill").isin(list(pinned))) if pinned else used


def usage(events: DataFrame) -> DataFrame:
    """Calls and characters of each command."""
    return events.groupBy("cmd").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"))


def latest(events: DataFrame, n: int = 5) -> DataFrame:
    return events.orderBy(F.col("ts").desc()).limit(n)


def compared(baseline: int, other: int) -> tuple[int, float]:
    """Tokens saved, and their share in percent to one digit."""
    saved = baseline - other
    return saved, round(100 * saved / baseline, 1) if baseline else 0.0


def truncated(events: DataFrame, keep: float = LEDGER_KEEP) -> DataFrame:
    """The newest floor(n * keep) events; ranked within days, so no window holds the whole ledger."""
    n = int(events.count() * keep)
    days = events.groupBy(F.to_date("ts").alias("_day")).agg(F.count("*").alias("_n"))
    later = F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a day
    ranked = events.withColumn("_day", F.to_date("ts")).join(F.broadcast(days.withColumn("_later", later)), "_day")
    place = F.row_number().over(Window.partitionBy("_day").orderBy(F.col("ts").desc())) + F.col("_later")
    return ranked.withColumn("_place", place).filter(F.col("_place") <= n).select(*events.columns)


def rotated(spark: SparkSession, path: str, into: str, most: int = LEDGER_BYTES, keep: float = LEDGER_KEEP) -> bool:
    """Where the files of a hit ledger take more than `most` bytes, write its newest events (`truncated`) as a ledger in `into`; whether that was so."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getContentSummary(place).getLength() <= most:
        return False
    truncated(read_hits(spark, path), keep).write.json(into)
    return True


def last_entries(lines: DataFrame, most: int = CORRECTION_LINES, mark: str = "## ") -> DataFrame:
    """Of a log (n, line) of more than `most` lines the last, from the first entry that begins among them; where none does, all of the last."""
    tail = lines.orderBy(F.col("n").desc()).limit(most)
    facts = tail.agg(F.min("n").alias("_low"), F.min(F.when(F.startswith("line", F.lit(mark)), F.col("n"))).alias("_mark"))
    facts = facts.crossJoin(F.broadcast(lines.agg(F.count("*").alias("_all")))).select(F.when(F.col("_all") > most, F.coalesce("_mark", "_low")).otherwise(F.col("_low")).alias("_from"))
    return tail.join(F.broadcast(facts), F.col("n") >= F.col("_from")).drop("_from")


def windows(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events, zero hits and users by tumbling or sliding window of time, and kind."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_hits") == 0, 1).otherwise(0)).alias("zero")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "kind", "n", "zero")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")
