"""Writers of the catalog: Parquet tables, compact JSON, Markdown, CSV, text, bundles, dashboard data and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T


def minimal_json(entries: DataFrame) -> DataFrame:
    """One line of JSON for each entry, with short keys."""
    return entries.select(F.to_json(F.struct(F.col("name").alias("n"), F.col("description").alias("d"), F.col("triggers").alias("g"), F.col("type").alias("t"), F.col("has_references").alias("r"), F.col("source").alias("s"))).alias("value"))


def minimal_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.col("source").alias("s"), F.col("target").alias("t"), F.col("type").alias("k"), F.col("weight").alias("w"))).alias("value"))


def markdown(entries: DataFrame) -> DataFrame:
    """Rows of a table; bars are escaped and lines are joined."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\|", "\\\\|"), "\\s*\\n\\s*", " ")
    return entries.select(F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("name")), cell(F.col("type")), cell(F.col("description")), cell(F.array_join("triggers", "、"))), F.lit(" |")).alias("value"))


def catalog_markdown(entries: DataFrame) -> DataFrame:
    """type, ord, value: a section of skills and one of MCP servers: a heading with their number, and the lines of each entry."""
    kept = entries.filter(F.col("type").isin("skill", "mcp"))
    lines = F.array_compact(F.array(
        F.concat(F.lit("- **"), "name", F.lit("**"), F.when(F.coalesce("has_references", F.lit(False)), " (含参考资料)").otherwise(""), F.lit(": "), F.coalesce("description", F.lit(""))),
        F.when(F.size(F.coalesce("triggers", T.none())) > 0, F.concat(F.lit("  - 触发: "), F.array_join("triggers", "、"))),
        F.concat(F.lit("  - 位置: `"), F.coalesce("path", F.lit("")), F.lit("`"))))
    heads = kept.groupBy("type").agg(F.count("*").alias("n")).select("type", F.lit("").alias("ord"), F.concat(F.lit("## "), F.upper("type"), F.lit("（"), F.col("n").cast("string"), F.lit("）")).alias("value"))
    return heads.unionByName(kept.select("type", "ord", F.array_join(lines, "\n").alias("value")))


def csv_rows(entries: DataFrame) -> DataFrame:
    return entries.select("name", "type", "description", F.array_join("triggers", "、").alias("triggers"), "source", "has_references")


def write_index(entries: DataFrame, edges: DataFrame, path: str) -> None:
    """The catalog as tables below path."""
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_bundle(entries: DataFrame, edges: DataFrame, path: str) -> None:
    """Names, dense lines, full texts and edges as layers that are read one by one."""
    found = entries.filter(~F.coalesce("excluded", F.lit(False)))
    found.select("name").write.mode("overwrite").text(f"{path}/L0")
    found.select(T.dense_line().alias("value")).write.mode("overwrite").text(f"{path}/L1")
    found.select("id", "full_text").write.mode("overwrite").parquet(f"{path}/L2")
    minimal_edges(edges).write.mode("overwrite").text(f"{path}/edges")


def write(entries: DataFrame, form: str, path: str) -> None:
    """form: json, md, csv or txt."""
    if form == "csv":
        csv_rows(entries).write.mode("overwrite").option("header", True).csv(path)
        return
    rows = {"json": minimal_json, "md": markdown, "txt": lambda e: e.select(T.dense_line().alias("value"))}[form](entries)
    rows.write.mode("overwrite").text(path)


def dashboard(entries: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the links whose two ends are nodes."""
    nodes = entries.select("id", "name", "type", "visibility", T.clipped(T.one_line(F.col("description")), 120).alias("description"))
    ids = nodes.select("id")
    links = edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, F.col("target") == ids["id"], "left_semi")
    return nodes, links


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
