"""Text functions of the catalog as column expressions; none of them runs Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.fixed import CLAUSE_WORDS, CONCEPTS, STOP_WORDS

STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(STRINGS)


def terms(text: Column) -> Column:
    """Distinct terms: runs of two or more ASCII letters and digits, and two- and three-grams of CJK runs, lower-cased."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))
    grams = F.flatten(F.transform(F.regexp_extract_all(low, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0)), lambda run: F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.when(
        F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))).otherwise(none())))))
    return F.array_distinct(F.concat(latin, F.when(low.rlike("[\\u4e00-\\u9fff]"), grams).otherwise(none())))


def joined(*columns: Column) -> Column:
    return F.concat_ws(" ", *columns)


def without_stop_words(found: Column) -> Column:
    return F.filter(found, lambda t: ~F.exists(F.array(*map(F.lit, STOP_WORDS)), lambda s: F.contains(t, s)))


def bridge_table(spark: SparkSession) -> DataFrame:
    """(term, other) both ways."""
    pairs = [(zh, en) for zh, words in CONCEPTS.items() for en in words]
    return spark.createDataFrame(pairs + [(en, zh) for zh, en in pairs], "term string, other string")


def _covers(t: Column, o: Column, low: Column) -> Column:
    """Whether o covers t: by holding it, or by lying over most of it in the query."""
    a, b, la, lb = F.position(t, low), F.position(o, low), F.length(t), F.length(o)
    shared = F.least(a + la, b + lb) - F.greatest(a, b)
    return (o != t) & (F.contains(o, t) | ((a > 0) & (b > 0) & ((lb > la) | ((lb == la) & (o < t))) & (2 * shared > F.least(la, lb))))


def maximal(overlap: Column, query: Column, term=lambda x: x) -> Column:
    """Of overlapping terms those that no other covers."""
    low = F.lower(query)
    return F.filter(overlap, lambda x: ~F.exists(overlap, lambda y: _covers(term(x), term(y), low)))


def asked(rows: DataFrame, covers=_covers) -> DataFrame:
    """qid, terms, coverers of rows (qid, query, term): a query's terms in order, and of each the places of those that cover it.

    What covers what follows from the query alone, so it is settled once a query and not for each entry it meets.
    """
    low = F.lower("query")
    every = rows.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.first("query").alias("query"))
    places = lambda t: F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: covers(t, F.get("terms", i), low))
    return every.select("qid", "terms", F.transform("terms", places).alias("coverers"))


def uncovered(overlap: str, coverers: str) -> Column:
    """Of overlap (structs with `pos`, a term's place in its query) those of which no coverer overlaps too."""
    present = F.transform(overlap, lambda x: x["pos"])
    return F.filter(overlap, lambda x: ~F.arrays_overlap(F.get(coverers, x["pos"]), present))


def description_weight(text: Column) -> Column:
    """Length with characters above U+2E80 as two."""
    wide = F.length(F.regexp_replace(text, "[\\u0000-\\u2e80]", ""))
    return F.length(text) + wide


def estimated_tokens(chars: Column) -> Column:
    return F.bround(chars.cast("double") / 4, 0).cast("bigint")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def dense_line(quota: int = 400, triggers: int = 8) -> Column:
    """One line for an entry: name[tag]: description | triggers, clipped to quotas."""
    letter = F.when(F.col("type") == "skill", "s").when(F.col("type") == "agent", "a").when(F.col("type") == "connector", "c").otherwise("m")
    tag = F.concat(letter, F.when(F.coalesce("has_references", F.lit(False)), "R").otherwise(""))
    found = F.slice(F.filter(F.coalesce("triggers", none()), lambda t: t != ""), 1, triggers)
    tail = F.when(F.size(found) > 0, F.concat(F.lit(" | 触发: "), F.array_join(found, "、"))).otherwise("")
    return F.concat("name", F.lit("["), tag, F.lit("]: "), clipped(one_line(F.col("description")), quota), tail)


def identifier_parts(name: Column) -> Column:
    """The identifier itself, then its parts by case and separators, lower-cased, of two or more characters."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[-_:. /]+")
    return F.array_distinct(F.concat(F.array(name), F.filter(parts, lambda p: F.length(p) > 1)))


def extracted_triggers(description: Column, most: int = 8, words: int = 5) -> Column:
    """Triggers named in a description: listed after a CJK or English label, or else the phrases of a "use when" clause.

    A clause ends with its sentence; its phrases lose the function words in front and are cut to `words` words.
    """
    one = lambda p: F.nullif(F.regexp_extract(description, p, 1), F.lit(""))
    listed = F.coalesce(one("触发词[：:]\\s*([^\n]+)"), one("(?i)\\bTriggers?\\b[：:]\\s*([^\n]+)"))
    clause = one("(?i)(?:trigger when|use when)[：:]?\\s*([^。.；;！？!?]+)")
    front = "(?i)^(?:(?:" + "|".join(CLAUSE_WORDS) + ")[.,;:!?]*(?:\\s+|$))+"
    phrase = lambda p: F.regexp_replace(F.array_join(F.slice(F.split(F.regexp_replace(F.trim(p), front, ""), "\\s+"), 1, words), " "), "^[.,;:!?]+|[.,;:!?]+$", "")
    found = F.when(listed.isNotNull(), F.split(listed, "[、,，;；/|\\s]+")).otherwise(F.transform(F.split(F.coalesce(clause, F.lit("")), "[、,，;；/|]+"), phrase))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t != "")), 1, most)


def synthesized_triggers(name: Column, description: Column, declared: Column, most: int = 8) -> Column:
    """What is declared, then the parts of the name, then what the description names: the first of those alike but for case, in order."""
    every = F.concat(F.coalesce(declared, none()), identifier_parts(name), extracted_triggers(F.coalesce(description, F.lit(""))))
    every = F.filter(F.transform(every, lambda t: F.trim(t)), lambda t: t != "")
    first = lambda found: F.filter(found, lambda t, i: F.array_position(F.transform(found, lambda x: F.lower(x)), F.lower(t)) == i + 1)
    return F.slice(F.get(F.transform(F.array(every), first), F.lit(0)), 1, most)


def safe_dirname(name: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^\\w\\u4e00-\\u9fff.-]", "_"), "\\.\\.", "__"), "^[. ]+|[. ]+$", ""), F.lit(120))


def uncovered_gap(query: Column, evidence: Column, n_hits: Column) -> Column:
    """Whether hits exist but no CJK term of the query holds, or lies in, any of their evidence."""
    cjk = F.filter(terms(query), lambda t: t.rlike("[\\u4e00-\\u9fff]"))
    return (F.size(cjk) > 0) & (n_hits > 0) & F.forall(cjk, lambda t: ~F.exists(evidence, lambda e: F.contains(e, t) | F.contains(t, e)))
