"""How the sources of a language differ in their terms: distances of all pairs, and the terms a source has more of than its language.

Terms are counted a task at a time before they are shuffled. A pair's distance starts from the baseline, as if neither source
had any term; each source's terms correct it, and so do the terms that both have, so work follows what occurs and not the
vocabulary. The first 50 terms of a source are found by radix select: histograms over bits of the value give the value of the
50th, histograms over growing beginnings of the UTF-8 bytes part those that tie, and only what is left is sorted.

Defined cases: null text, lang and source are empty strings; repeated rows count each; a text without terms counts for its
group alone; texts of any length are read in pieces; other columns are ignored, however named; an empty table gives no rows.
A language without kept terms gives its pairs with 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import shuffle_width, slices, tidy, written

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of texts with A-Z lowered
LETTERS = frozenset(range(97, 123)) | frozenset(range(128, 256))
LEAST_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
SAFE = 9_000_000_000  # counts below it stay within 64 bits when scaled
HELD_TERMS = 200_000  # of a task, counted before they leave it
PIECE = 1 << 20
SIDE = 256  # sources of a block of distances
HELD_BLOCKS = 64  # of half a megabyte, before they leave a task
DIGITS = (21, 10, 0)  # a value's bits from here up, one after the other: values are below 2**32
FEW = 1_000  # ties that are sorted as they are


def pieces(raw: bytes) -> Iterator[bytes]:
    """The lowered text in pieces of about PIECE bytes that cut no term; a term longer than that is a piece."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        part = raw[at:end].lower()
        if end < len(raw) and part[-1] in LETTERS:
            while end < len(raw) and (raw[end] | 32 if 65 <= raw[end] <= 90 else raw[end]) in LETTERS:
                end += 1
            part = raw[at:end].lower()
        yield part
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs: of the task's documents."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            names, own = list(terms), docs[lang, source]
            for a in range(0, len(names), 20_000):
                part = names[a : a + 20_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in part], pa.int64()), pa.array([own[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "count", "docs"])
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for part, texts in slices(batch, 0):
            for text, lang, source in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist()):
                group = (lang, source)
                if group not in counts:
                    counts[group], docs[group] = Counter(), Counter()
                seen: set[bytes] = set()
                before = len(counts[group])
                for piece in pieces(text):
                    found = TERM.findall(piece)
                    counts[group].update(found)
                    seen.update(found)
                docs[group].update(seen)
                held += len(counts[group]) - before
            if held > HELD_TERMS:
                yield from flushed()
                held = 0
    yield from flushed()


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / total) of two columns, exact for any count: beyond 64 bits in decimals."""
    near = f"({SCALE}L * ({count} + {PRIOR})) div {total}"
    far = f"(cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(19, 0))) div cast({total} as decimal(19, 0))"
    return F.expr(f"1L + if({count} < {SAFE}L, {near}, cast({far} as bigint))")


def _both(schema: pa.Schema):
    """Of each term's sources the corrections of all pairs, summed in blocks of a language before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[str, int]] = {}
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), block in sums.items():
                names = list(numbers[lang])
                a, b = np.nonzero(block)
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([names[i * SIDE + x] for x in a.tolist()], pa.string()), pa.array([names[j * SIDE + x] for x in b.tolist()], pa.string()), pa.array(block[a, b], pa.int64())],
                    schema=schema)
            sums.clear()

        for batch in batches:
            for lang, sources, ps, bases in zip(*(c.to_pylist() for c in batch.columns)):
                known = numbers.setdefault(lang, {})
                at = np.array([known.setdefault(s, len(known)) for s in sources])
                p, base = np.array(ps, np.int64), np.array(bases, np.int64)
                order = np.argsort(at)
                at, p, base = at[order], p[order], base[order]
                cuts = np.r_[0, np.flatnonzero(np.diff(at // SIDE)) + 1, len(at)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    for c, d in zip(cuts[:-1], cuts[1:]):
                        x, y, bx, by = p[a:b, None], p[None, c:d], base[a:b, None], base[None, c:d]
                        key = (lang, int(at[a] // SIDE), int(at[c] // SIDE))
                        if key not in sums:
                            if len(sums) >= HELD_BLOCKS:
                                yield from flushed()
                            sums[key] = np.zeros((SIDE, SIDE), np.int64)
                        sums[key][np.ix_(at[a:b] % SIDE, at[c:d] % SIDE)] += abs(x - y) - abs(x - by) - abs(y - bx) + abs(bx - by)
        yield from flushed()

    return tidy(run)


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: distance of all ordered pairs of a language's sources, over all its kept terms.

    cells: lang, source, term, p of terms that occur in the source; groups: lang, source, base (the p of those that don't), kept.
    """
    spark = cells.sparkSession
    width = shuffle_width(spark)
    both = [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]
    own = groups.select("lang", "source", "base")
    of_term = cells.join(own, ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("cells"))
    shared = of_term.filter(F.size("cells") > 1).select("lang", "cells.source", "cells.p", "cells.base").mapInArrow(_both(pa.schema(both)), "lang string, source string, item string, value long")
    # values of a source's terms, with their numbers, against each other source's base, dealt by salt
    values = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(own, ["lang", "source"]).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(width).cast("bigint")))
    others = own.select("lang", F.col("source").alias("item"), F.col("base").alias("other"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("salt"))
    moved = F.col("n") * (F.abs(F.col("p") - F.col("other")) - F.abs(F.col("base") - F.col("other")))
    one = values.join(others, ["lang", "salt"]).filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(moved).alias("value"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    ends = groups.alias("a").join(groups.alias("b"), F.expr("a.lang = b.lang and a.source <> b.source"))
    still = ends.select("a.lang", "a.source", F.col("b.source").alias("item"), F.expr("a.kept * abs(a.base - b.base)").alias("value"))
    every = still.unionByName(one).unionByName(back).unionByName(shared.filter("source <> item"))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def first_terms(found: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group the k highest values, ties by the item's bytes, by radix select.

    found: lang, source, item, value; it is read once a digit.
    """
    group, high = ["lang", "source"], Window.partitionBy("lang", "source")
    sizes = found.groupBy(*group).count()
    few = sizes.filter(F.col("count") <= k).select(*group)
    state = sizes.filter(F.col("count") > k).select(*group, F.lit(0).cast("bigint").alias("prefix"), F.lit(k).cast("bigint").alias("need"))
    above = 63
    for shift in DIGITS:  # the prefix of the kth value grows by a digit; need: how many of those with the prefix are taken
        seen = found.join(state, group).filter(F.shiftright("value", above) == F.col("prefix") if above < 63 else F.lit(True))
        counts = seen.groupBy(*group, "need", F.shiftright("value", shift).alias("digit")).count()
        counts = counts.withColumn("through", F.sum("count").over(high.orderBy(F.desc("digit"))))
        reached = counts.filter(F.col("through") >= F.col("need")).withColumn("n", F.row_number().over(high.orderBy(F.desc("digit")))).filter("n = 1")
        state = written(reached.select(*group, F.col("digit").alias("prefix"), (F.col("need") - (F.col("through") - F.col("count"))).alias("need"), F.col("count").alias("ties")))
        above = shift
        if shift:
            state = state.drop("ties")
    kth = state.select(*group, F.col("prefix").alias("kth"), "need", "ties")
    sure = found.join(kth, group).filter("value > kth").select(found.columns)
    tied = written(found.join(kth, group).filter("value = kth").select(*found.columns, "need", "ties"))
    taken, length = [found.join(few, group, "left_semi").select(found.columns), sure], 4
    while True:  # ties: all, few enough to sort, or parted by more bytes
        taken.append(tied.filter("ties <= need").select(found.columns))
        near = tied.filter(f"ties > need and ties <= {FEW}")
        taken.append(near.withColumn("n", F.row_number().over(high.orderBy("item"))).filter("n <= need").select(found.columns))
        tied = tied.filter(f"ties > need and ties > {FEW}")
        if tied.isEmpty():
            break
        tied = tied.withColumn("head", F.expr(f"substring(cast(item as binary), 1, {length})"))
        heads = tied.groupBy(*group, "need", "head").count().withColumn("through", F.sum("count").over(high.orderBy("head")))
        heads = heads.withColumn("before", F.col("through") - F.col("count")).filter("before < need").select(*group, "head", "before", "count")
        tied = tied.join(heads, [*group, "head"]).withColumn("need", F.col("need") - F.col("before"))
        tied = written(tied.select(*found.columns, F.least("need", "count").alias("need"), F.when(F.col("count") <= F.col("need"), F.least("need", "count")).otherwise(F.col("count")).alias("ties"), "head"))
        taken.append(tied.filter("ties <= need").select(found.columns))
        tied = written(tied.filter("ties > need").drop("head"))
        length *= 2
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", F.row_number().over(high.orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    empty = F.lit("")
    rows = docs.select(F.coalesce("text", empty).alias("text"), F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"))
    counted = rows.mapInArrow(tidy(_counted), "lang string, source string, term string, count long, docs long").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    cells = counted.withColumns({"all_docs": F.sum("docs").over(of_term), "all_count": F.sum("count").over(of_term)}).filter(F.col("all_docs") >= LEAST_DOCS)
    cells = written(cells.select("lang", "source", "term", "count", "all_count"))
    langs = cells.groupBy("lang", "term").agg(F.first("all_count").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = written(groups.withColumns({"all_units": F.col("total") + PRIOR * F.col("kept"), "lang_units": F.col("lang_total") + PRIOR * F.col("kept")}))
    base = F.when(F.col("kept") > 0, share("0L", "all_units")).otherwise(0)
    groups = groups.withColumn("base", base)
    known = cells.join(groups.select("lang", "source", "all_units", "lang_units"), ["lang", "source"])
    known = written(known.select("lang", "source", "term", share("count", "all_units").alias("p"), share("all_count", "lang_units").alias("q")))
    apart = pairs(known.drop("q"), groups)
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(own))
    more = first_terms(written(known.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return apart.withColumn("part", F.lit("pair")).select(names).unionByName(more.withColumn("part", F.lit("term")).select(names))


#: Distances over all terms and sources, as they are defined.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), cells AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs) GROUP BY lang, source, term
), kept AS (
  SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term HAVING sum(docs) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, l.v, l.total AS lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 * (n + 5) AS BIGINT) // CAST(total + 5 * v AS BIGINT) AS p, 1 + CAST(1000000000 * (lang_n + 5) AS BIGINT) // CAST(lang_total + 5 * v AS BIGINT) AS q FROM counts
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
), terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
