"""Answers to questions by stages: entries, then contents, then a refreshed catalog, each for questions that are still open alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators.chunks import content_finder
from shelfmark.operators.retrieval import collaborators, name_twins, search
from shelfmark.schema import Search
from shelfmark.shared import tabled

PASSAGES, NEIGHBOURS = 5, 5
HIT = "qid, rank, id, name, score, evidence, tied, basis"


def _open(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return tabled(queries.join(hits.select("qid").distinct(), "qid", "left_anti"))


def by_content(queries: DataFrame, entries: DataFrame, find: Callable[[DataFrame, int], DataFrame], top: int) -> DataFrame:
    """Entries, not excluded, whose contents a question meets: of each the best of the first `top` passages, in that order."""
    found = find(queries, top).withColumn("low", F.lower("skill"))
    first = found.groupBy("qid", "low").agg(F.min("rank").alias("r"), F.max("score").alias("score"))
    named = entries.filter(~F.coalesce("excluded", F.lit(False))).groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("ord", "id", "name")).alias("e"))
    rows = first.join(named, "low").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("r", "low")))
    rows = rows.join(queries.select("qid", "query"), "qid")
    return rows.select("qid", "rank", F.col("e.id").alias("id"), F.col("e.name").alias("name"), "score", F.array("query").alias("evidence"), F.lit(False).alias("tied"), F.lit("content").alias("basis"))


def answered(queries: DataFrame, entries: DataFrame, find: Callable[[DataFrame, int], DataFrame], refresh: Callable[[DataFrame], DataFrame | None] | None = None, options: Search = Search()) -> DataFrame:
    """HIT columns: entries by search; for questions without any, those whose contents they meet; for what is open then, entries
    by search in what refresh(open questions) gives (None: nothing has changed). basis: entries, content or refreshed.

    find(queries, top): passages as content_search gives them, from chunks or a kept index. A stage runs only if the one before
    left a question open, and on open questions alone.
    """
    columns = HIT.split(", ")
    hits = tabled(search(queries, entries, options).withColumn("basis", F.lit("entries")).select(columns))
    left = _open(queries, hits)
    if not left.isEmpty():
        hits = hits.unionByName(tabled(by_content(left, entries, find, options.limit).select(columns)))
        left = _open(left, hits)
        newer = refresh(left) if refresh is not None and not left.isEmpty() else None
        if newer is not None:
            hits = hits.unionByName(tabled(search(left, newer, options).withColumn("basis", F.lit("refreshed")).select(columns)))
    return hits


def neighbours(hits: DataFrame, entries: DataFrame, edges: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """id, neighbours: of each hit the names it is most strongly tied to; of those that no edge touches, names that share most terms."""
    wanted = hits.select("id").distinct()
    ways = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "weight"))
    tied = tabled(ways.join(wanted, "id", "left_semi"))
    alone = wanted.join(tied.select("id").distinct(), "id", "left_anti")
    if not alone.isEmpty():
        tied = tied.unionByName(collaborators(entries, edges, only=alone).select(F.col("node").alias("id"), "other", F.col("weight").cast("double").alias("weight")).join(alone, "id", "left_semi"))
    near = tied.join(entries.select(F.col("id").alias("other"), F.col("name").alias("_name")), "other").groupBy("id", "_name").agg(F.max("weight").alias("weight"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "_name"))).filter(F.col("r") <= most)
    return near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "_name"))), lambda x: x["_name"]).alias("neighbours"))


def chat(queries: DataFrame, entries: DataFrame, edges: DataFrame, chunks: DataFrame | None = None, find: Callable[[DataFrame, int], DataFrame] | None = None, refresh=None, options: Search = Search()) -> DataFrame:
    """qid, rank, id, name, score, basis, weak, gap, twins, neighbours, passages: a row a hit; of a question that stays open one without a name.

    weak: the first hit has one term of evidence; gap: CJK terms of the question are in no evidence; passages: where the
    contents meet the question, for all questions. chunks, or find (see `answered`) over a kept index.
    """
    find, edges = find or content_finder(chunks, queries), tabled(edges.select("source", "target", "weight"))
    hits = answered(queries, entries, find, refresh, options)
    gap = queries.join(hits.groupBy("qid").agg(F.flatten(F.collect_list("evidence")).alias("_all")), "qid", "left")
    gap = gap.select("qid", T.uncovered_gap(F.col("query"), F.coalesce("_all", T.none()), F.when(F.col("_all").isNull(), 0).otherwise(1)).alias("gap"))
    line = F.concat("skill", F.lit(" / "), "file", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    said = find(queries, PASSAGES).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("at")))), lambda x: x["at"]).alias("passages"))
    twins = name_twins(entries, only=hits).groupBy("name").agg(F.array_sort(F.collect_set("twin")).alias("twins"))
    rows = hits.join(neighbours(hits, entries, edges), "id", "left").join(twins, "name", "left").withColumn("weak", (F.col("rank") == 1) & (F.size("evidence") == 1))
    every = gap.join(rows, "qid", "left").join(said, "qid", "left")
    return every.select("qid", "rank", "id", "name", "score", F.coalesce("basis", F.lit("open")).alias("basis"), F.coalesce("weak", F.lit(False)).alias("weak"), "gap", *[F.coalesce(c, T.none()).alias(c) for c in ("twins", "neighbours", "passages")])
