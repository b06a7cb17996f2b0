"""Coverage, economy, doctor and listing reports over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.schema import DENSE_DESCRIPTION, DENSE_TRIGGERS, DOCTOR_BIG, DOCTOR_WEIGHT


def listed(entries: DataFrame, kind: str | None = None, visibility: str | None = "ready", with_references: bool = False, agent: str | None = None, limit: int | None = None) -> DataFrame:
    rows = entries
    if kind:
        rows = rows.filter(F.col("type") == kind)
    if visibility:
        rows = rows.filter(F.coalesce("visibility", F.lit("ready")) == visibility)
    if with_references:
        rows = rows.filter("has_references")
    if agent:
        rows = rows.filter(F.array_contains("agents", agent))
    return rows.orderBy("ord").limit(limit) if limit else rows


def lookup(entries: DataFrame, names: DataFrame) -> DataFrame:
    """The first entry, by type and name, of each asked name, whatever its case."""
    asked = names.select(F.lower("name").alias("_low")).distinct()
    return entries.join(asked, F.lower("name") == F.col("_low")).groupBy("_low").agg(F.min_by(F.struct("id", "name", "type", "visibility"), "ord").alias("e")).select("e.*")


def coverage(entries: DataFrame) -> DataFrame:
    """One row of counts of the whole catalog."""
    some = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    kind = lambda k: some(F.col("type") == k)
    return entries.agg(
        F.count("*").alias("total"), kind("skill").alias("skills"), kind("mcp").alias("mcps"), kind("connector").alias("connectors"), kind("agent").alias("agents"),
        some(F.col("visibility") == "ready").alias("ready"), some(F.col("visibility") == "blocked").alias("blocked"), some(F.col("visibility") == "off-list").alias("off_list"),
        some(F.coalesce("excluded", F.lit(False))).alias("excluded"), some(F.col("has_references")).alias("with_references"), some(F.size("triggers") > 0).alias("with_triggers"),
        some(F.col("agent_bound").eqNullSafe(False)).alias("unbound"), F.coalesce(F.sum(F.length("full_text")), F.lit(0)).alias("full_text_chars"))


def coverage_by(entries: DataFrame, mode: str, *columns: str) -> DataFrame:
    """Counts by every prefix of columns (rollup) or by every subset (cube)."""
    grouped = entries.rollup(*columns) if mode == "rollup" else entries.cube(*columns)
    return grouped.agg(F.count("*").alias("n"), F.sum(F.length("full_text")).alias("chars"), F.grouping_id().alias("level"))


def token_economy(entries: DataFrame, k: int = 8) -> DataFrame:
    """Characters of full texts, dense lines and names of what can be found, with ratios; null where there is nothing."""
    rows = entries.filter(~F.coalesce("excluded", F.lit(False))).withColumn("line", T.dense_line(DENSE_DESCRIPTION, DENSE_TRIGGERS))
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("full_text")), F.lit(0)).alias("full_chars"), F.coalesce(F.sum(F.length("line") + 1), F.lit(0)).alias("l1_chars"), F.coalesce(F.sum(F.length("name") + 1), F.lit(0)).alias("l0_chars"))
    some = F.col("n") > 0
    return sums.select(
        "n", "full_chars", "l1_chars", "l0_chars", T.estimated_tokens(F.col("full_chars")).alias("full_tokens"), T.estimated_tokens(F.col("l1_chars")).alias("l1_tokens"),
        F.when(some & (F.col("l1_chars") > 0), F.round(F.col("full_chars") / F.col("l1_chars"), 6)).alias("density"), F.when(some, F.round(F.col("l1_chars") / F.col("n"), 6)).alias("average_line"),
        F.when(some, F.round(100.0 * (1 - F.least(F.lit(k), F.col("n")) / F.col("n")), 6)).alias("inject_saving"))


def dense_lines(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.coalesce("excluded", F.lit(False))).select("id", T.dense_line(DENSE_DESCRIPTION, DENSE_TRIGGERS).alias("line"))


def heaviest(entries: DataFrame, top: int = 10) -> DataFrame:
    return entries.select("name", F.length("full_text").alias("chars")).orderBy(F.col("chars").desc(), "name").limit(top)


def doctor(entries: DataFrame) -> DataFrame:
    """finding, name: the first text fault of each skill, oversized ones, and names that occur more than once."""
    d = F.trim(F.coalesce("description", F.lit("")))
    zh = F.trim(F.coalesce("description_zh", F.lit("")))
    first = F.when(T.description_weight(d) < DOCTOR_WEIGHT, "bad_description").when(F.size(F.coalesce("triggers", T.none())) == 0, "no_triggers").when((zh == "") & ~d.rlike("[^\\u0000-\\u2e80]"), "no_zh_description")
    big = F.when(F.octet_length("full_text") > DOCTOR_BIG, "oversized")
    one = entries.filter("type = 'skill'").select(F.explode(F.array_compact(F.array(first, big))).alias("finding"), "name")
    twice = entries.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("finding"), "name")
    return one.unionByName(twice)


def excluded_by_globs(entries: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """name, reason: the first of ordered (glob, reason) rules that a lower-cased name matches."""
    rule = F.lit(None).cast("string")
    for glob, reason in reversed(globs):
        rule = F.when(F.lower("name").rlike(glob_regex(glob.lower())), reason).otherwise(rule)
    return entries.select("name", rule.alias("reason")).filter("reason is not null")


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression over the whole string; * and ? take any character."""
    out, i = [], 0
    while i < len(glob):
        c, close = glob[i], glob.find("]", i + 2)
        if c == "[" and close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
            i = close
        else:
            out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() else c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
