"""A mirror of a list: a document for each item under a name that no other has, written anew only where an item changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.shared import tabled
from shelfmark.sources.store import Generation, Store

#: What marks a document that has an item's description alone.
STUB_MARK = "made from a list: the description alone, not the whole document"
LEAST_BODY = 40  # characters of a body that is worth keeping

ROW = "dirname string, name string, text string, stub boolean, fingerprint string, segment bigint"


def _candidate() -> Column:
    return F.when(F.col("i") == 1, F.col("safe")).otherwise(F.concat("safe", F.lit("-"), F.col("i").cast("string")))


def assigned(items: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """items with dirname: in their order each takes its safe name, or the first of safe-2, safe-3, ... that none before it took.

    order is unique. All propose at once; a name goes to the earliest that proposes it, and who loses proposes the next, so the
    outcome is that of taking turns. Of items with one safe name the nth can't do better than the nth, where it begins, so
    rounds go on only for names that meet those made for others.
    """
    rank = F.row_number().over(Window.partitionBy("safe").orderBy(order))
    live = tabled(items.withColumn("safe", T.safe_dirname(F.col(name))).select(order, "safe").withColumn("i", rank))
    while True:
        named = live.withColumn("dirname", _candidate())
        wins = named.groupBy("dirname").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
        told = tabled(named.join(wins, "dirname"))
        if told.filter("_n > 1").isEmpty():
            return items.join(told.select(order, "dirname"), order)
        live = tabled(told.select(order, "safe", F.when(F.col(order) == F.col("_first"), F.col("i")).otherwise(F.col("i") + 1).alias("i")))


def documents(items: DataFrame) -> DataFrame:
    """dirname, name, text, stub, fingerprint of items (name, description, body, ord): the body where there is one, under front
    matter if it has none, else a stub; the fingerprint is over all of it."""
    line = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), "\n", " "))
    body = F.when(F.length(F.trim(F.coalesce("body", F.lit("")))) > LEAST_BODY, F.col("body"))
    head = F.concat(F.lit("---\nname: "), F.col("name"), F.lit("\ndescription: "), line, F.lit("\n---\n\n"))
    whole = F.when(F.startswith(F.ltrim(body), F.lit("---")), body).otherwise(F.concat(head, body))
    stub = F.concat(head, F.lit("# "), F.col("name"), F.lit("\n\n"), line, F.lit(f"\n\n> {STUB_MARK}\n"))
    rows = assigned(items).withColumn("text", F.coalesce(whole, stub)).withColumn("stub", body.isNull())
    return rows.select("dirname", "name", "text", "stub", F.sha1(F.concat_ws("\x1f", "name", "text")).alias("fingerprint"))


def mirror(store: Store, items: DataFrame) -> tuple[Generation, DataFrame]:
    """The mirror of a list as it is now, and of each document what changed: added, updated, kept or removed.

    Documents whose fingerprint is as it was are not written; others go to a folder of their own, which the next generation
    names beside those before. `dropped` names documents that are no more as of some segment. If none changed, no generation is made.
    """
    spark, base = items.sparkSession, store.current()
    old = base or Generation(0)
    segment = int(old.facts.get("segment", 0)) + 1
    now = tabled(documents(items))
    before = living(store, old).select("dirname", F.col("fingerprint").alias("_was"), F.lit(True).alias("_old")) if old.number else spark.createDataFrame([], "dirname string, _was string, _old boolean")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("name").isNull(), "removed").when(F.col("fingerprint") == F.col("_was"), "kept").otherwise("updated")
    both = tabled(now.join(before, "dirname", "full").withColumn("change", change))
    told = both.select("dirname", "name", "stub", "change")
    if base is not None and old.number and told.filter("change <> 'kept'").isEmpty():
        return old, told
    parts = {
        "rows": both.filter("change in ('added', 'updated')").select("dirname", "name", "text", "stub", "fingerprint", F.lit(segment).cast("bigint").alias("segment")),
        "dropped": both.filter("change in ('removed', 'updated')").select("dirname", F.lit(segment).cast("bigint").alias("as_of")),
    }
    tables = {}
    for name, rows in parts.items():
        made = store.written(rows)
        tables[name] = {"paths": [*(old.tables[name]["paths"] if name in old.tables else []), *made["paths"]], "schema": made["schema"]}
    return store.commit(base, tables, {"segment": segment}), told


def living(store: Store, generation: Generation) -> DataFrame:
    """The documents of a mirror: of each name those not dropped since they were written."""
    rows, gone = store.read(generation, "rows"), store.read(generation, "dropped").groupBy("dirname").agg(F.max("as_of").alias("as_of"))
    return rows.join(gone, "dirname", "left").filter("as_of is null or segment >= as_of").drop("as_of")


def is_stub(text: Column) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit(STUB_MARK))
