"""Batch retrieval: many queries against the catalog in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators.alike import most_alike
from shelfmark.schema import EVIDENCE_GATE, GATE_POOL, IDF_CAP, LOCATION_WEIGHT, LONG_TAIL, NAME_FACTOR, PINNED_FACTOR, REFERENCES_BONUS, TIE_RATIO, Search
from shelfmark.shared import shuffled_to, tabled

ENTRY_KEYS = ("id", "name", "ord", "has_references")


def pool(entries: DataFrame, options: Search = Search()) -> DataFrame:
    """The entries that can be found: not excluded, or off-list where that is asked for; unbound ones drop out of agent_only, unknown ones stay."""
    keep = F.col("name") != options.self_name
    if not options.include_excluded:
        off = F.col("visibility").eqNullSafe("off-list")
        keep = keep & (~F.coalesce("excluded", F.lit(False)) | (off if options.include_off_list else F.lit(False)))
    if options.agent_only:
        keep = keep & ~F.col("agent_bound").eqNullSafe(False)
    return entries.filter(keep)


def entry_postings() -> Column:
    """An entry's terms as structs (term, loc) at their best place: 0 name, 1 trigger, 2 description."""
    name, triggers = T.terms(F.col("name")), T.terms(F.concat_ws(" ", "triggers"))
    said = T.terms(T.joined(F.col("description"), F.col("description_zh")))
    place = lambda terms, loc: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(loc).alias("loc")))
    return F.concat(place(name, 0), place(F.array_except(triggers, name), 1), place(F.array_except(said, F.concat(name, triggers)), 2))


def postings(entries: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep columns, term, loc, without a shuffle."""
    return entries.select(*keep, F.explode(entry_postings()).alias("p")).select(*keep, "p.term", "p.loc")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.1), 1.0 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
    rows = queries.select("qid", "query", F.explode(T.terms(F.col("query"))).alias("term"))
    if bridge is None:
        return rows
    return rows.unionByName(rows.join(bridge, "term").select("qid", "query", F.col("other").alias("term"))).distinct()


def plan(queries: DataFrame, options: Search = Search()) -> DataFrame:
    """qid, terms, coverers of each query."""
    return T.asked(query_terms(queries, T.bridge_table(queries.sparkSession) if options.bridge else None))


def numbered(entries: DataFrame, keep: tuple[str, ...], terms: Column) -> DataFrame:
    """keep columns, k (a number of the row's own), terms: written, so numbers last and texts are tokenised once."""
    return tabled(entries.select(*keep, terms.alias("terms")).withColumn("k", F.monotonically_increasing_id()))


MOST_WANTED, MOST_ASKED = 500_000, 10_000  # terms of queries, and queries, that are broadcast
POSTINGS = 100_000  # of a partition: each meets all queries that ask for its term

Rows = Callable[..., DataFrame]


def candidates(asked: DataFrame, posted: DataFrame, size: DataFrame, df: DataFrame | None = None, by: str = "k") -> Rows:
    """rows(pairs): posted's columns (k and perhaps others; t, a number, in place of term), qid, pos, idf, n: each term of a query
    that an entry has, with its place in the query's terms; of some pairs (qid, k) or of all.

    asked: of `plan`; size: one row with n, the number of entries. Postings are cut to query terms and written before anything
    is counted, so their shuffle is as large as what queries ask about. df (term, df): of all entries, where it is kept.
    Postings are dealt by `by` before they meet the queries, so what each makes of its pairs needs no further shuffle.
    """
    wanted = tabled(asked.select("qid", F.posexplode("terms").alias("pos", "term")))
    near = F.broadcast if wanted.count() <= MOST_WANTED else lambda x: x
    terms = tabled(wanted.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    posted = tabled(posted.join(near(terms), "term").drop("term"))
    df = posted.groupBy("t").agg(F.count("*").alias("df")) if df is None else df.join(near(terms), "term").select("t", "df")
    weights = df.join(F.broadcast(size)).select("t", idf(F.col("df"), F.col("n")).alias("idf"), "n")  # size is one row
    wanted = tabled(wanted.join(near(terms), "term").join(weights, "t").select("t", "qid", "pos", "idf", "n"))
    parts = max(shuffled_to(posted.sparkSession), posted.count() // POSTINGS)

    def rows(pairs: DataFrame | None = None) -> DataFrame:
        if pairs is None:
            return posted.repartition(parts, by).join(near(wanted), "t")
        of = pairs.groupBy("k").agg(F.collect_set("qid").alias("_of"))
        found = posted.join(of, "k").repartition(parts, by).join(near(wanted), "t")
        return found.filter(F.array_contains("_of", F.col("qid"))).drop("_of")

    return rows


def with_plan(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows with their queries' terms and coverers, left where they are if queries are few."""
    return rows.join(F.broadcast(asked) if asked.count() <= MOST_ASKED else asked, "qid")


def shortlist(pairs: DataFrame, exact: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Of pairs (qid, k, bound: no less than the score) those that may be among the `most` best of their query.

    The first few by bound are scored exactly; a pair whose bound is below the score that `most` of them reach is out. Queries
    with fewer keep all their pairs. The ranks are cut to that number before they are shuffled. Both sets of pairs are written,
    so their size is known where terms are joined to them: few are broadcast, and the terms of all others stay where they are.
    """
    pairs = tabled(pairs)
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "k"))).filter(F.col("r") <= 4 * most)
    sure = exact(tabled(first.select("qid", "k"))).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).filter(F.col("r") == most)
    return tabled(pairs.join(tabled(sure.select("qid", F.col("score").alias("least"))), "qid", "left").filter("least is null or bound + 0.00001 >= least").select("qid", "k"))


def entry_candidates(queries: DataFrame, entries: DataFrame, options: Search = Search()) -> tuple[DataFrame, Rows, DataFrame]:
    """Plan, candidates and heads (k, the entries' keys and g, a number of the id, by which all is dealt) of the pool."""
    found, asked = pool(entries, options).withColumn("g", F.xxhash64("id")), tabled(plan(queries, options))
    heads = numbered(found, (*ENTRY_KEYS, "g"), entry_postings())
    posted = heads.select("g", "k", F.explode("terms").alias("p")).select("g", "k", "p.term", "p.loc")
    return asked, candidates(asked, posted, heads.agg(F.count("*").alias("n")), by="g"), heads.drop("terms")


def place_weight(loc: Column) -> Column:
    return F.when(loc == 0, LOCATION_WEIGHT[0]).when(loc == 1, LOCATION_WEIGHT[1]).otherwise(LOCATION_WEIGHT[2])


def scored(queries: DataFrame, entries: DataFrame, options: Search = Search()) -> DataFrame:
    """qid, id, name, ord, score, evidence, kept terms: what passes the gate, before the long tail is cut."""
    asked, rows, heads = entry_candidates(queries, entries, options)
    return weighed(asked, rows, heads, tabled(bounded(rows, options)), options)


def _gate() -> Column:
    return EVIDENCE_GATE * F.least(F.lit(1.0), F.col("n") / GATE_POOL)


def bounded(rows: Rows, options: Search) -> DataFrame:
    """qid, k, bound: pairs that may pass the gate, with the score they have at most, as if no term covered another."""
    sums = rows().groupBy("g", "qid", "k").agg(F.sum(F.least("idf", F.lit(IDF_CAP)) * place_weight(F.col("loc"))).alias("ev"), F.max(F.when(F.col("loc") == 0, F.col("idf"))).alias("named"), F.first("n").alias("n"))
    bound = F.col("ev") + F.coalesce(F.least("named", F.lit(IDF_CAP)) * NAME_FACTOR, F.lit(0.0)) + REFERENCES_BONUS
    return sums.filter((F.col("ev") + 0.00001 >= _gate()) | F.col("named").isNotNull()).select("qid", "k", (bound * (PINNED_FACTOR if options.pinned else 1.0)).alias("bound"))


def weighed(asked: DataFrame, rows: Rows, heads: DataFrame, pairs: DataFrame, options: Search = Search()) -> DataFrame:
    """scored, of some pairs; the terms of a query and what covers them are joined to entries, not to each of their terms."""
    rows = rows(pairs).groupBy("g", "qid", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "loc", "idf"))).alias("overlap"), F.first("n").alias("n"))
    rows = with_plan(rows, asked)
    rows = rows.withColumn("kept", T.uncovered("overlap", "coverers"))
    rows = rows.withColumn("ev", F.aggregate("kept", F.lit(0.0), lambda a, x: a + F.least(x["idf"], F.lit(IDF_CAP)) * place_weight(x["loc"])))
    named = F.filter("overlap", lambda x: x["loc"] == 0)
    rows = rows.withColumn("bonus", F.when(F.size(named) > 0, F.least(F.array_max(F.transform(named, lambda x: x["idf"])), F.lit(IDF_CAP)) * NAME_FACTOR).otherwise(0.0))
    rows = rows.filter((F.col("ev") >= _gate()) | (F.size(named) > 0))
    heads = heads.withColumnsRenamed({"g": "_g", "k": "_k"})
    rows = rows.join(heads, (F.col("g") == F.col("_g")) & F.coalesce(F.col("k") == F.col("_k"), F.lit(False)))  # dealt by g alone
    score = F.col("ev") + F.col("bonus") + F.when(F.coalesce("has_references", F.lit(False)), REFERENCES_BONUS).otherwise(0.0)
    if options.pinned:
        score = score * F.when(F.lower("name").isin([p.lower() for p in options.pinned]), PINNED_FACTOR).otherwise(1.0)
    rows = rows.select("g", "qid", "k", "id", F.struct(F.round(score, 6).alias("score"), F.round("ev", 6).alias("ev"), "name", "ord", F.transform("kept", lambda x: F.get("terms", x["pos"])).alias("evidence")).alias("x"))
    best = rows.groupBy("g", "qid", "id").agg(F.max_by("k", "x").alias("k"), F.max("x").alias("x"))  # repeated entries are one
    return best.select("qid", "id", "x.name", "x.ord", "x.score", "x.ev", "x.evidence", "k")


def search(queries: DataFrame, entries: DataFrame, options: Search = Search()) -> DataFrame:
    """The best entries of each query: qid, rank, id, name, score, ev, evidence, tied."""
    asked, rows, heads = entry_candidates(queries, entries, options)
    pairs = shortlist(bounded(rows, options), lambda some: weighed(asked, rows, heads, some, options).select("qid", "k", "score"), options.limit)
    return ranked(weighed(asked, rows, heads, pairs, options), options)


def ranked(rows: DataFrame, options: Search = Search()) -> DataFrame:
    """search, from what is scored."""
    by_query = Window.partitionBy("qid")
    rows = rows.withColumn("most", F.max("ev").over(by_query)).filter(F.col("score") >= F.greatest(F.lit(options.min_score), LONG_TAIL * F.col("most")))
    rows = rows.withColumn("rank", F.row_number().over(by_query.orderBy(F.col("score").desc(), "ord"))).filter(F.col("rank") <= options.limit)
    best = F.max("score").over(by_query)
    rows = rows.withColumn("best", best)
    group = F.sum(F.when(F.col("score") >= TIE_RATIO * F.col("best"), 1).otherwise(0)).over(by_query)
    return rows.withColumn("tied", (group >= 2) & (F.col("score") >= TIE_RATIO * F.col("best")) & (F.col("rank") <= 4)).drop("most", "best", "ord", "k")


def search_or_refresh(queries: DataFrame, entries: DataFrame, refresh, options: Search = Search()) -> DataFrame:
    """search, and once more for queries without hits where refresh(missed) gives other entries (None: nothing has changed).

    refresh is called at most once, and only where a query has no hits.
    """
    hits = tabled(search(queries, entries, options))
    missed = tabled(queries.join(hits.select("qid").distinct(), "qid", "left_anti"))
    newer = None if missed.isEmpty() else refresh(missed)
    return hits if newer is None else hits.unionByName(search(missed, newer, options))


def single_character(queries: DataFrame, entries: DataFrame, options: Search = Search()) -> DataFrame:
    """For queries without terms: literal hits in name (6.0), triggers (3.0), description (1.5)."""
    rows = entries.filter(F.col("name") != options.self_name)
    if not options.include_excluded:
        rows = rows.filter(~F.coalesce("excluded", F.lit(False)))
    if options.agent_only:
        rows = rows.filter(~F.col("agent_bound").eqNullSafe(False))
    asked = queries.withColumn("raw", F.lower(F.trim("query"))).filter((F.size(T.terms(F.col("query"))) == 0) & (F.col("raw") != ""))
    # A stated query set against all entries; the condition is a substring, so there is no key to join by.
    both = rows.join(F.broadcast(asked), F.contains(F.lower(F.concat_ws("\n", "name", F.concat_ws(" ", "triggers"), "description")), F.col("raw")))
    score = F.when(F.contains(F.lower("name"), F.col("raw")), 6.0).when(F.contains(F.lower(F.concat_ws(" ", "triggers")), F.col("raw")), 3.0).when(F.contains(F.lower("description"), F.col("raw")), 1.5)
    ranked = both.withColumn("score", score).filter("score is not null").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.lower("name"))))
    return ranked.filter(F.col("rank") <= options.limit).select("qid", "rank", "name", "score")


def name_twins(entries: DataFrame, most: int = 3, only: DataFrame | None = None) -> DataFrame:
    """name, twin: entries whose name goes on from another's by a hyphen, either way, not excluded; by hyphen prefixes, an equi-join.

    only (name): of those names alone, so only what meets them is joined.
    """
    rows = entries.select("name", F.lower("name").alias("low"), "ord", "excluded")
    parts = F.split("low", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    longer = rows.filter(F.contains(F.col("low"), F.lit("-"))).select("name", "ord", "excluded", F.explode(prefixes).alias("low"))
    chosen = tabled(only.select("name").distinct()) if only is not None else None
    few = lambda x: x if chosen is None else tabled(x.join(chosen, "name", "left_semi"))
    pairs = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.low") == F.col("b.low"))
    down = pairs(longer, few(rows)).select(F.col("b.name").alias("name"), F.col("a.name").alias("twin"), F.col("a.ord").alias("ord"), F.col("a.excluded").alias("out"))
    up = pairs(few(longer), rows).select(F.col("a.name").alias("name"), F.col("b.name").alias("twin"), F.col("b.ord").alias("ord"), F.col("b.excluded").alias("out"))
    both = down.unionByName(up).filter(~F.coalesce("out", F.lit(False)))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).filter(F.col("n") <= most).select("name", "twin")


def collaborators(entries: DataFrame, edges: DataFrame, top: int = 3, only: DataFrame | None = None) -> DataFrame:
    """node, rank, other, weight: for entries that no edge touches, the entries, not excluded, that share most terms with them.

    The share is of both entries' terms, all-digit terms aside; weight is 0.5 and twice the share, 0.95 at most. Entries of one
    id are one, with the terms of all. only (id): of those nodes alone.
    """
    touched = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    alone = tabled((entries if only is None else only).select("id").distinct().join(touched, "id", "left_anti"))
    if alone.isEmpty():
        return entries.sparkSession.createDataFrame([], "node string, rank int, other string, weight double")
    text = T.joined(F.col("name"), F.col("description"), F.col("description_zh"), F.concat_ws(" ", "triggers"))
    sets = tabled(entries.select("id", "ord", F.lower("name").alias("low"), F.coalesce("excluded", F.lit(False)).alias("out"), T.terms(text).alias("terms")).filter(F.size("terms") > 0))
    ranked = most_alike(sets, alone, top)
    return ranked.select("node", "rank", F.col("id").alias("other"), F.bround(F.least(F.lit(0.95), 0.5 + 2 * F.col("share")), 2).alias("weight"))


def report(queries: DataFrame, entries: DataFrame, edges: DataFrame, options: Search = Search()) -> DataFrame:
    """The hits of each query with what a reader is told beside them: twins of the name, neighbours, else collaborators, and
    whether none of the query's CJK terms is in any evidence (gap).

    qid, rank, id, name, score, tied, evidence, twins, neighbours, gap; a query without hits has one row without a name.
    """
    hits, edges = tabled(search(queries, entries, options)), tabled(edges.select("source", "target", "weight"))
    twins = name_twins(entries).groupBy("name").agg(F.array_sort(F.collect_set("twin")).alias("twins"))
    both_ways = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "weight"))
    near = both_ways.unionByName(collaborators(entries, edges, only=hits).select(F.col("node").alias("id"), "other", "weight")).join(hits.select("id").distinct(), "id", "left_semi")
    near = near.join(entries.select(F.col("id").alias("other"), F.col("name").alias("_name")), "other").groupBy("id", "_name").agg(F.max("weight").alias("weight"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("weight").desc(), "_name"))).filter("r <= 5").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "_name"))), lambda x: x["_name"]).alias("neighbours"))
    gap = queries.join(hits.groupBy("qid").agg(F.flatten(F.collect_list("evidence")).alias("_all")), "qid", "left")
    gap = gap.select("qid", T.uncovered_gap(F.col("query"), F.coalesce("_all", T.none()), F.when(F.col("_all").isNull(), 0).otherwise(1)).alias("gap"))
    rows = hits.select("qid", "rank", "id", "name", "score", "tied", "evidence").join(twins, "name", "left").join(near, "id", "left")
    return gap.join(rows, "qid", "left").select("qid", "rank", "id", "name", "score", "tied", "evidence", F.coalesce("twins", T.none()).alias("twins"), F.coalesce("neighbours", T.none()).alias("neighbours"), "gap")
