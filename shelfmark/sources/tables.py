"""The catalog's tables derived from a directory of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.shared import MOST_KEYS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as entries, the whole text as description; `ord` orders them by type and lower-cased name and settles ties."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    if l.count() <= MOST_KEYS:  # texts stay where they are
        l = F.broadcast(l.select("doc_id", "quality", "toxic"))
    rows = d.join(l, "doc_id", "left")
    kind = F.col("doc_id") % 20
    visibility = F.when(F.col("toxic") == 1, "blocked").when(F.col("toxic").isNull(), "off-list").otherwise("ready")
    name = F.concat("lang", F.expr("cast(doc_id div 12 as string)"), F.lit("-"), F.col("doc_id").cast("string"))
    rows = rows.select(
        "doc_id", name.alias("name"), F.when(kind == 0, "mcp").when(kind == 1, "connector").when(kind == 2, "agent").otherwise("skill").alias("type"),
        F.col("text").alias("description"), F.lit(None).cast("string").alias("description_zh"),
        F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)), 1, 3).alias("triggers"), "source", F.col("text").alias("full_text"),
        (F.col("n_chars") > 1500).alias("has_references"), visibility.alias("visibility"), (F.col("quality") == 1).alias("agent_bound"))
    return rows.withColumns({"excluded": F.col("visibility") != "ready", "id": F.concat_ws(":", "type", "name"), "ord": F.concat("type", F.lit(" "), F.lower("name"))})


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def hit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("view", "search", "click", "chat", "signup", "pipeline", "purchase", "adopt", "error", "search")])[F.col("event_type")]
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat(F.lit("q"), (F.col("user_id") % 37).cast("string")).alias("query"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("n_hits"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("skill"), "user_id", "event_type", "value")


def dependencies(entries_df: DataFrame) -> DataFrame:
    """The directed acyclic graph of entries i on i div 3."""
    a = entries_df.filter("doc_id > 0").select(F.expr("doc_id div 3").alias("on"), F.col("id").alias("source"))
    b = entries_df.select(F.col("doc_id").alias("on"), F.col("id").alias("target"))
    return a.join(b, "on").select("source", "target", F.lit("depends_on").alias("type"), F.lit("directed").alias("direction"), F.lit(0.8).alias("weight"))
