"""What stands beside a config: of each entity the nearest document that describes it, by a join on the paths where one may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import manifest
from shelfmark.functions import text as T

#: Where a document of an entity may be, from a folder on, first of all first; {} is the entity's name.
PLACES = (
    "SKILL.md", "skills/SKILL.md", "skill/SKILL.md", "skills/{}/SKILL.md", "skills/connector-{}/SKILL.md", "connector-{}/SKILL.md", "{}/SKILL.md",
    "connector.json", "manifest.json", "agent.json", "package.json", "instructions.md", "README.md", "readme.md")
#: Fields of a JSON document that describe it, and that list triggers, in order of precedence.
DESCRIBED, LISTED = ("description_zh", "description", "summary", "displayName", "prompt"), ("triggers", "keywords", "tags")
LEAST_LINE = 7  # characters of a line that says something


def described(texts: DataFrame) -> DataFrame:
    """path, description, triggers of documents (path, text): by front matter, by JSON fields, or by the first line that says something."""
    kind = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    one = texts.filter(kind == "skill.md").select("path", manifest.fields("text").alias("m")).select("path", F.coalesce(F.nullif("m.description_zh", F.lit("")), "m.description").alias("description"))
    one = one.withColumn("triggers", T.extracted_triggers(F.coalesce("description", F.lit(""))))
    value = F.try_parse_json("text")
    first = lambda names, t: F.coalesce(*[F.try_variant_get("v", f"$.{n}", t) for n in names])
    said = F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")) for n in DESCRIBED])
    two = texts.filter(kind.endswith(".json")).select("path", value.alias("v")).select("path", said.alias("description"), F.coalesce(first(LISTED, "array<string>"), T.none()).alias("triggers"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", "")))
    line = F.get(F.filter(lines, lambda x: (F.length(x) >= LEAST_LINE) & ~F.left(x, F.lit(1)).isin("[", "!")), F.lit(0))
    three = texts.filter(kind.isin("instructions.md", "readme.md")).select("path", line.alias("description"), T.none().alias("triggers"))
    return one.unionByName(two).unionByName(three).filter("description <> ''")


def _above(path: Column, levels: int) -> Column:
    """The path's folder, and those above it, `levels` in all at most, nearest first."""
    parts = F.split(path, "/")
    here = F.size(parts) - 1
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: here - n > 0), lambda n: F.array_join(F.slice(parts, 1, here - n), "/"))


def nearest(entities: DataFrame, documents: DataFrame, levels: int = 2) -> DataFrame:
    """entities (name, path of the config, and others) with found (path), found_description, found_triggers of the nearest document; null where there is none.

    Of folders the nearest, of a folder's places the first in PLACES. An entity is looked up at so many places by equality, so
    neither folders nor documents are compared with each other. documents: of `described`; one for each path.
    """
    at = F.flatten(F.transform(_above(F.col("path"), levels), lambda folder, up: F.array(*[
        F.struct((up * len(PLACES) + i).alias("rank"), F.concat(folder, F.lit("/"), *_named(p)).alias("at")) for i, p in enumerate(PLACES)])))
    asked = entities.select("name", "path").distinct().select("name", "path", F.explode(at).alias("x")).select("name", "path", "x.rank", "x.at")
    hits = asked.join(documents.select(F.col("path").alias("at"), F.struct("description", "triggers").alias("d")), "at")
    best = hits.groupBy("name", "path").agg(F.min(F.struct("rank", "at", "d")).alias("b"))
    best = best.select(F.col("name").alias("_name"), F.col("path").alias("_path"), F.col("b.at").alias("found"), F.col("b.d.description").alias("found_description"), F.col("b.d.triggers").alias("found_triggers"))
    return entities.join(best, F.col("name").eqNullSafe(F.col("_name")) & F.col("path").eqNullSafe(F.col("_path")), "left").drop("_name", "_path")


def _named(place: str) -> list[Column]:
    before, mark, after = place.partition("{}")
    return [F.lit(before), F.col("name"), F.lit(after)] if mark else [F.lit(place)]


def introspected(entities: DataFrame, documents: DataFrame, levels: int = 2) -> DataFrame:
    """entities (name, type, path, description, triggers) with description from themselves, else from the nearest document, else
    from what they are; and triggers from what is declared there, the name's parts, and the description."""
    rows = nearest(entities, documents, levels)
    own = F.when(F.length(F.trim(F.coalesce("description", F.lit("")))) > 0, F.col("description"))
    declared = F.concat(F.coalesce("triggers", T.none()), F.when(own.isNull(), F.coalesce("found_triggers", T.none())).otherwise(T.none()))
    told = F.coalesce(own, "found_description", F.concat_ws(" ", "type", "name"))
    rows = rows.withColumns({"_told": told, "_declared": declared})
    return rows.select(*entities.drop("description", "triggers").columns, F.col("_told").alias("description"), T.synthesized_triggers(F.col("name"), F.col("_told"), F.col("_declared")).alias("triggers"), "found")
