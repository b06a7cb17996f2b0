"""The typed graph of entries: five kinds of edges, neighbours, impact, diagnosis and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators.retrieval import document_frequency, idf
from shelfmark.shared import tabled
from shelfmark.schema import (
    EDGE_CLIQUE, EDGE_DF, EDGE_GROUP, EDGE_MIN_JACCARD, EDGE_TOP_K, EDGE_WEIGHT, HUB_FACTOR, HUB_LEAST, HUB_PRUNES, SIMILAR_MIN_SHARED, SIMILAR_TOP_K,
)


def entry_text() -> Column:
    return T.joined(F.col("name"), F.col("description"), F.col("description_zh"), F.concat_ws(" ", "triggers"))


def entry_terms(entries: DataFrame) -> DataFrame:
    """id, term: distinct terms of name, descriptions and triggers."""
    return entries.select("id", F.explode(T.terms(entry_text())).alias("term"))


HOT = 1_000  # a term in more than one of so many entries is hot; entries of T terms on average have at most T * HOT of them


def _hot(df: DataFrame, n: DataFrame, most: int) -> DataFrame:
    """term: of more than `most` rows and of a large share of all n (one row), to be broadcast; most postings are of these."""
    return F.broadcast(df.crossJoin(F.broadcast(n)).filter((F.col("df") > most) & (F.col("df") * HOT > F.col("n"))).select("term"))


def overlap_pairs(entries: DataFrame, df_range: tuple[int, int] = EDGE_DF, least: float = 0.0) -> DataFrame:
    """u, v, shared, jaccard: pairs of skills by shared terms of middling frequency, from a Jaccard similarity of `least` on.

    A term's postings are at most df_range[1] long, so a term makes a bounded number of pairs however large the catalog is.
    Entries are tokenised once. What a pair can share beyond the terms counted is bounded by each side's number of frequent
    ones, so whole sets of terms are joined only for pairs that may reach `least`.
    """
    skills = entries.filter("type = 'skill'")
    sets = tabled(skills.select("id", T.terms(entry_text()).alias("terms")).filter(F.size("terms") > 0).withColumn("k", F.monotonically_increasing_id()))
    posted = sets.select("k", F.explode("terms").alias("term"))
    df = tabled(document_frequency(posted).filter(F.col("df") >= df_range[0]))
    lo, hi = df_range
    hot = _hot(df, sets.agg(F.count("*").alias("n")), hi)
    often = posted.join(hot, "term", "left_semi").groupBy("k").agg(F.count("*").alias("often"))
    posted = posted.join(hot, "term", "left_anti")
    rare = posted.join(df.filter(F.col("df").between(lo, hi)).select("term"), "term")
    pairs = rare.withColumnRenamed("k", "u").join(rare.withColumnRenamed("k", "v"), "term").filter("u < v").groupBy("u", "v").agg(F.count("*").alias("shared")).filter("shared >= 2")
    frequent = posted.join(df.filter(F.col("df") > hi).select("term"), "term").groupBy("k").agg(F.count("*").alias("frequent"))
    sizes = sets.select("k", F.size("terms").alias("n")).join(frequent, "k", "left").join(often, "k", "left").na.fill(0, ["frequent", "often"])
    sizes = tabled(sizes.select("k", "n", (F.col("frequent") + F.col("often")).alias("frequent")))
    for end in ("u", "v"):
        pairs = pairs.join(sizes.select(F.col("k").alias(end), F.col("n").alias(f"n{end}"), F.col("frequent").alias(f"f{end}")), end)
    able = pairs.filter(F.col("shared") >= least * (F.col("nu") + F.col("nv") - F.col("shared") - F.least("fu", "fv"))).select("u", "v", "shared")
    for end in ("u", "v"):
        able = able.join(sets.select(F.col("k").alias(end), F.col("id").alias(f"i{end}"), F.col("terms").alias(f"t{end}")), end)
    union = F.size("tu") + F.size("tv") - F.size(F.array_intersect("tu", "tv"))
    found = able.select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v"), "shared", (F.col("shared") / union).alias("jaccard"))
    return found.filter(F.col("jaccard") >= least)


def overlap_candidates(entries: DataFrame) -> DataFrame:
    return overlap_pairs(entries, least=EDGE_MIN_JACCARD).select("u", "v", "shared", F.bround("jaccard", 3).alias("weight"))


def capped(pairs: DataFrame, cap: int = EDGE_TOP_K, most_rounds: int | None = None) -> DataFrame:
    """u, v, weight accepted greedily by weight, then u, v, with at most `cap` at a node.

    Rounds of locally dominant pairs: a pair is taken when it ranks within what is left at both its ends. Each round cuts
    its lineage by written tables; the outcome equals the sequential one. A node takes part in a few rounds only. Rounds go on
    until no pair is live; where most_rounds is given and does not suffice, an error says so.
    """
    live, taken = tabled(pairs.select("u", "v", "weight")), None
    rounds = 0
    while not live.isEmpty():
        if rounds == most_rounds:
            raise RuntimeError(f"capping did not settle in {most_rounds} rounds")
        rounds += 1
        room = live.select(F.col("u").alias("node")).unionByName(live.select(F.col("v").alias("node"))).distinct()
        if taken is not None:
            used = taken.select(F.col("u").alias("node")).unionByName(taken.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("used"))
            room = room.join(used, "node", "left").withColumn("left", cap - F.coalesce("used", F.lit(0))).drop("used")
        else:
            room = room.withColumn("left", F.lit(cap))
        ends = live.withColumn("node", F.explode(F.array("u", "v"))).join(room, "node")
        order = Window.partitionBy("node").orderBy(F.col("weight").desc(), "u", "v")
        fit = tabled(ends.withColumn("fits", F.row_number().over(order) <= F.col("left")).groupBy("u", "v", "weight").agg(F.min(F.col("fits").cast("int")).alias("fits")))
        more = fit.filter("fits = 1").select("u", "v", "weight")
        taken = more if taken is None else taken.unionByName(more)
        used = taken.withColumn("node", F.explode(F.array("u", "v"))).groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= cap).select("node")
        rest = fit.filter("fits = 0").select("u", "v", "weight")
        live = tabled(rest.join(used, rest["u"] == used["node"], "left_anti").join(used, F.col("v") == used["node"], "left_anti"))
    return taken if taken is not None else live


def namespaces(entries: DataFrame) -> DataFrame:
    parts = F.split("name", "[-_.]")
    return entries.filter((F.size(parts) >= 2) & (F.length(parts[0]) >= 3)).withColumn("ns", F.lower(parts[0]))


def family_edges(entries: DataFrame) -> DataFrame:
    """Entries of one namespace: all pairs in small groups, a star from the least id in larger ones, none in huge ones."""
    rows = namespaces(entries).select("ns", "id")
    sizes = rows.groupBy("ns").agg(F.count("*").alias("n"), F.min("id").alias("root")).filter(F.col("n").between(*EDGE_GROUP))
    rows = rows.join(sizes, "ns")
    small = rows.filter(F.col("n") <= EDGE_CLIQUE)
    clique = small.select("ns", F.col("id").alias("source")).join(small.select("ns", F.col("id").alias("target")), "ns").filter("source < target").select("source", "target")
    star = rows.filter((F.col("n") > EDGE_CLIQUE) & (F.col("id") != F.col("root"))).select(F.col("root").alias("source"), F.col("id").alias("target"))
    return clique.unionByName(star).withColumns({"type": F.lit("family"), "direction": F.lit("undirected"), "weight": F.lit(EDGE_WEIGHT["family"])})


def contains_edges(entries: DataFrame) -> DataFrame:
    """From a namespace's root, the skill of that name or else the shortest one, to its other skills."""
    skills = entries.filter("type = 'skill'").select("id", "name", "ord")
    rows = namespaces(skills)
    roots = rows.groupBy("ns").agg(F.count("*").alias("n"), F.min(F.struct(F.length("name").alias("l"), "ord", "id")).alias("s")).filter("n >= 2")
    exact = skills.groupBy(F.lower("name").alias("ns")).agg(F.max(F.struct("ord", "id")).alias("e"))
    roots = roots.join(exact, "ns", "left").select("ns", F.coalesce(F.col("e.id"), F.col("s.id")).alias("source"))
    return rows.join(roots, "ns").filter("id <> source").select("source", F.col("id").alias("target")).distinct().withColumns({"type": F.lit("contains"), "direction": F.lit("directed"), "weight": F.lit(EDGE_WEIGHT["contains"])})


def name_references(entries: DataFrame) -> DataFrame:
    """depends_on edges from entries whose description or triggers hold another's name at ASCII word bounds.

    Names are cut from texts at those bounds and joined by equality; a name of several such words is looked up by every
    run of so many words as any name has, so the join is never by pattern.
    """
    named = entries.filter(F.col("type").isin("skill", "mcp")).select(F.lower("name").alias("low"), F.col("id").alias("target")).groupBy("low").agg(F.max("target").alias("target"))
    plain = named.filter(F.col("low").rlike("^[a-z0-9_-]+$"))
    words = entries.filter("type = 'skill'").select(F.col("id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(T.joined(F.col("description"), F.concat_ws(" ", "triggers"))), F.lit("[a-z0-9_-]+"), F.lit(0)))).alias("low"))
    # Words of a shape that no name has need no shuffle; there are few shapes, whatever the number of names.
    shape = F.struct(F.least(F.length("low"), F.lit(64)).alias("l"), *[F.contains("low", F.lit(x)).alias(f"x{i}") for i, x in enumerate("-_")], F.col("low").rlike("[0-9]").alias("d"), F.col("low").rlike("[a-z]").alias("a"))
    words = words.withColumn("shape", shape).join(F.broadcast(plain.select(shape.alias("shape")).distinct()), "shape", "left_semi")
    by_word = words.join(plain, "low").filter("source <> target").select("source", "target")
    kind = {"type": F.lit("depends_on"), "direction": F.lit("directed"), "weight": F.lit(EDGE_WEIGHT["depends_on"])}
    other = named.filter(~F.col("low").rlike("^[a-z0-9_-]+$"))
    if other.isEmpty():
        return by_word.distinct().withColumns(kind)
    texts = entries.filter("type = 'skill'").select(F.col("id").alias("source"), F.lower(T.joined(F.col("description"), F.concat_ws(" ", "triggers"))).alias("body"))
    # A name with other characters is looked up by its longest plain run, which the text must have as a whole run; bodies
    # are brought in once for each text that has the run of any such name.
    runs = F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("run")))), 1)["run"]
    keyed = other.filter(F.size(runs) > 0).select("low", "target", longest.alias("key"))
    keys = texts.select("source", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[a-z0-9]+"), F.lit(0)))).alias("key"))
    maybe = keys.join(keyed, "key").groupBy("source").agg(F.collect_list(F.struct("low", "target")).alias("names"))
    literal = lambda low: F.concat(F.lit("(?<![a-z0-9_-])\\Q"), low, F.lit("\\E(?![a-z0-9_-])"))
    held = F.filter("names", lambda x: F.contains(F.col("body"), x["low"]) & F.rlike(F.col("body"), literal(x["low"])))
    by_text = texts.join(maybe, "source").select("source", F.explode(held).alias("x")).select("source", "x.target").filter("source <> target")
    return by_word.unionByName(by_text).distinct().withColumns(kind)


def similar_pairs(chunk_terms: DataFrame, **options) -> DataFrame:
    """u, v, shared, weight of skills by weighted Jaccard of rare terms (skill, term); of options, a budget of pairs, rarest terms first."""
    return _similar(chunk_terms, **options).withColumn("weight", F.round("weight", 6))


def similar_edges(chunk_terms: DataFrame, entries: DataFrame, least: float = EDGE_MIN_JACCARD, cap: int = SIMILAR_TOP_K) -> DataFrame:
    """u, v, weight of skills by id whose chunks' terms (skill by name, term) are alike from `least` on, at most `cap` at a node."""
    ids = entries.filter("type = 'skill'").groupBy(F.lower("name").alias("low")).agg(F.max(F.struct("ord", "id"))["id"].alias("id"))
    pairs = _similar(chunk_terms.withColumn("skill", F.lower("skill"))).filter(F.col("weight") >= least)
    pairs = pairs.join(ids.select(F.col("low").alias("u"), F.col("id").alias("a")), "u").join(ids.select(F.col("low").alias("v"), F.col("id").alias("b")), "v")
    return capped(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.bround("weight", 3).alias("weight")), cap)


def _budgeted(df: DataFrame, df_range: tuple[int, int], budget: int | None) -> DataFrame:
    """term, df, used: terms of middling frequency, and whether the pairs that they and all rarer ones make stay within the budget."""
    df = df.filter(F.col("df").between(*df_range))
    if budget is None:
        return df.withColumn("used", F.lit(True))
    df = tabled(df)
    by_df = df.groupBy("df").agg(F.count("*").alias("c")).withColumn("pairs", F.col("c") * F.expr("df * (df - 1) div 2"))
    ahead = F.sum("pairs").over(Window.orderBy("df").rowsBetween(Window.unboundedPreceding, -1))  # a row for each df, a few dozen
    by_df = by_df.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    # One frequency is cut within at most: rarer ones are used whole, more frequent ones not at all.
    whole = (F.col("ahead") + F.col("pairs") <= budget).alias("whole")
    df = df.join(F.broadcast(by_df.select("df", "ahead", whole, (F.col("ahead") < budget).alias("some"))), "df")
    inside = F.row_number().over(Window.partitionBy("df").orderBy("term")) - 1
    cut = df.filter("some and not whole").withColumn("used", F.col("ahead") + inside * F.expr("df * (df - 1) div 2") < budget)
    rest = df.filter("whole or not some").withColumn("used", F.col("whole"))
    return cut.select("term", "df", "used").unionByName(rest.select("term", "df", "used"))


def similar_dropped(chunk_terms: DataFrame, df_range: tuple[int, int] = EDGE_DF, budget: int | None = None) -> DataFrame:
    """terms, dropped, pairs_dropped: of the terms that similar pairs may be made from, what a budget leaves out."""
    told = _budgeted(document_frequency(chunk_terms.select("skill", "term").distinct()), df_range, budget)
    lost = F.when(~F.col("used"), F.expr("df * (df - 1) div 2")).otherwise(0)
    return told.agg(F.count("*").alias("terms"), F.count_if(~F.col("used")).alias("dropped"), F.coalesce(F.sum(lost), F.lit(0)).alias("pairs_dropped"))


MOST_FREQUENT = 500_000  # terms that are broadcast


def _no_more_than(posted: DataFrame, most: int) -> DataFrame:
    """posted (skill, term) without terms that are surely of more than `most` skills, which most postings are of.

    Skills fall into 64 classes; a term of more classes than `most` is of more skills, however often rows repeat.
    """
    if most >= 64:
        return posted
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64("skill"), F.lit(64)).cast("int"))
    frequent = tabled(posted.groupBy("term").agg(F.bit_count(F.bit_or(bit)).alias("least")).filter(F.col("least") > most).select("term"))
    return posted.join(F.broadcast(frequent) if frequent.count() <= MOST_FREQUENT else frequent, "term", "left_anti")


def _similar(chunk_terms: DataFrame, df_range: tuple[int, int] = EDGE_DF, min_shared: int = SIMILAR_MIN_SHARED, budget: int | None = None) -> DataFrame:
    """u, v, shared, weight; budget None: of all terms in the range, whatever their number."""
    raw = tabled(chunk_terms.select("skill", "term"))
    skills = tabled(raw.select("skill").distinct().withColumn("k", F.monotonically_increasing_id()))
    n = skills.agg(F.count("*").alias("n"))
    posted = tabled(_no_more_than(raw, df_range[1]).distinct())
    df = tabled(document_frequency(posted).filter(F.col("df").between(*df_range)))
    used = _budgeted(df, df_range, budget).filter("used").crossJoin(F.broadcast(n)).select("term", idf(F.col("df"), F.col("n")).alias("idf"))
    rare = tabled(posted.join(used, "term").join(skills, "skill").select("term", "idf", "k"))
    total = rare.groupBy("k").agg(F.sum("idf").alias("w"))
    # Terms of the very same skills, as copies have many, make their pairs once; a list is as long as a term is frequent.
    lists = rare.groupBy("term").agg(F.array_sort(F.collect_list("k")).alias("ks"), F.first("idf").alias("idf")).groupBy("ks").agg(F.count("*").alias("c"), F.sum("idf").alias("s"))
    firsts = lists.select("ks", "c", "s", F.posexplode("ks").alias("i", "u")).filter(F.col("i") < F.size("ks") - 1)
    pairs = firsts.select("u", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("v"), "c", "s").groupBy("u", "v").agg(F.sum("c").alias("shared"), F.sum("s").alias("s")).filter(F.col("shared") >= min_shared)
    for end in ("u", "v"):
        pairs = pairs.join(total.join(skills, "k").select(F.col("k").alias(end), F.col("w").alias(f"w{end}"), F.col("skill").alias(f"s{end}")), end)
    return pairs.select(F.least("su", "sv").alias("u"), F.greatest("su", "sv").alias("v"), "shared", (F.col("s") / (F.col("wu") + F.col("wv") - F.col("s"))).alias("weight"))


def all_edges(entries: DataFrame, overlap: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Edges of every kind, one for each source, target and type."""
    out = family_edges(entries).unionByName(name_references(entries)).unionByName(contains_edges(entries))
    for pairs, kind in ((overlap, "overlap"), (similar, "similar")):
        if pairs is not None:
            out = out.unionByName(pairs.select(F.col("u").alias("source"), F.col("v").alias("target"), F.lit(kind).alias("type"), F.lit("undirected").alias("direction"), "weight"))
    return out.groupBy("source", "target", "type").agg(F.min("direction").alias("direction"), F.max("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type", "weight").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "type", "weight"))


def neighbours(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node, other, type, weight, name: one-hop neighbours; those without an entry stay, with a null name."""
    return both_ways(edges).join(entries.select(F.col("id").alias("other"), "name"), "other", "left")


def related(edges: DataFrame, entries: DataFrame, top: int = 5) -> DataFrame:
    """The best edge to each neighbour that is not excluded, and of those the best `top` of each node."""
    rows = both_ways(edges).join(entries.filter(~F.coalesce("excluded", F.lit(False))).select(F.col("id").alias("other"), "ord"), "other")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("node", "other").orderBy(F.col("weight").desc(), "type"))).filter("r = 1").drop("r")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "ord"))).filter(F.col("rank") <= top).select("node", "rank", "other", "type", "weight")


def impact(edges: DataFrame) -> DataFrame:
    """node, level, dependent: what depends on a node directly, and what depends on that and not directly on the node."""
    deps = edges.filter("type = 'depends_on'").select(F.col("target").alias("node"), F.col("source").alias("dependent")).distinct()
    second = deps.select("node", F.col("dependent").alias("mid")).join(deps.select(F.col("node").alias("mid"), "dependent"), "mid").select("node", "dependent").filter("node <> dependent").distinct()
    second = second.join(deps, ["node", "dependent"], "left_anti")
    return deps.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def isolated(edges: DataFrame, entries: DataFrame) -> DataFrame:
    return entries.select("id").join(both_ways(edges).select(F.col("node").alias("id")), "id", "left_anti")


def conflicts(edges: DataFrame) -> DataFrame:
    """Pairs that depend on each other."""
    d = edges.filter("type = 'depends_on'").select("source", "target").distinct()
    return d.alias("a").join(d.alias("b"), (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source"))).filter("a.source < a.target").select("a.source", "a.target")


def mean_degree(edges: DataFrame) -> DataFrame:
    """mean: edge ends over the nodes that have any; one row."""
    return degrees(edges).agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean"))


def hubs(edges: DataFrame) -> DataFrame:
    """node, degree above three times the average over nodes that have edges, and five at least."""
    return degrees(edges).crossJoin(F.broadcast(mean_degree(edges))).filter((F.col("degree") > HUB_FACTOR * F.col("mean")) & (F.col("degree") >= HUB_LEAST)).select("node", "degree")


def dangling(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """contains edges of which an end is no entry."""
    rows, ids = edges.filter("type = 'contains'"), entries.select("id")
    lost = rows.join(ids, rows["source"] == ids["id"], "left_anti").unionByName(rows.join(ids, rows["target"] == ids["id"], "left_anti"))
    return lost.select("source", "target").distinct()


def _pruned(kept: DataFrame, limit: float, prunes: int | None = None) -> DataFrame:
    """kept less the lightest edges of nodes of more than `limit`, down to it; nodes in order of their first edge, each of the
    edges that those before it left; with prunes, nodes until more than so many edges are gone.

    An edge of two such nodes is the later one's only if the earlier one leaves it. All nodes choose at once, and again while
    what earlier ones take of their edges changes: a node's choice is right once those of all before it are.
    """
    key = ["source", "type", "target"]
    over = degrees(kept).filter(F.col("degree") > limit).withColumn("many", (F.col("degree") - int(limit)).cast("int"))
    ends = kept.select(*key, "weight", F.posexplode(F.array("source", "target")).alias("side", "node")).filter("side = 0 or source <> target")
    ends = tabled(ends.join(over.drop("degree"), "node"))
    seen = tabled(ends.groupBy("node", "many").agg(F.min(F.struct(*key, "side")).alias("seen")))
    if prunes is not None:  # each node loses one edge at least
        reached, total = [], 0
        for r in seen.orderBy("seen").limit(prunes + 1).collect():
            reached.append(r.node)
            total += r.many
            if total > prunes:
                break
        seen = seen.filter(F.col("node").isin(reached))
    order = Window.partitionBy("node").orderBy("lost", "weight", *key)
    both = Window.partitionBy(*key).orderBy("seen")
    # lost: an earlier node takes this edge; only edges of two such nodes can change, and the others wait in their node's order.
    rows = tabled(ends.join(seen.select("node", "seen"), "node").withColumn("lost", F.lit(False)))
    while True:
        chosen = rows.withColumn("taken", ~F.col("lost") & (F.row_number().over(order) <= F.col("many")))
        rows = tabled(chosen.withColumn("now", F.coalesce(F.lag("taken").over(both), F.lit(False))))
        if rows.filter("lost <> now").isEmpty():
            return kept.join(rows.filter("taken").select(*key).distinct(), key, "left_anti")
        rows = rows.withColumn("lost", F.col("now")).drop("taken", "now")


def repaired(edges: DataFrame, entries: DataFrame, prunes: int | None = HUB_PRUNES) -> DataFrame:
    """edges, mended: of mutual dependencies the lighter way goes, of equal ones the first by source; contains edges without
    an entry at an end go; nodes of more than three times the mean degree before (five at least) lose their lightest edges,
    all such nodes where prunes is None, else in order until more than so many edges are gone; and if there were isolated
    entries, entries that have no edge now get one by the greedy best overlap from 0.05 on, one a node.
    """
    # Steps build on each other and are read several times, so each is a written table.
    columns = ["source", "target", "type", "direction", "weight"]
    edges, entries = tabled(edges.select(*columns)), tabled(entries.select("id", "name", "type", "ord", "description", "description_zh", "triggers"))
    mutual = conflicts(edges)
    d = edges.filter("type = 'depends_on'").groupBy("source", "target").agg(F.max("weight").alias("weight"))
    ways = mutual.join(d.withColumnRenamed("weight", "w1"), ["source", "target"]).join(d.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("weight").alias("w2")), ["source", "target"])
    first = F.col("w2") >= F.col("w1")
    drop = ways.select(F.when(first, F.col("source")).otherwise(F.col("target")).alias("source"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("target"), F.lit("depends_on").alias("type"))
    drop = drop.unionByName(dangling(edges, entries).withColumn("type", F.lit("contains")))
    kept = tabled(edges.join(drop, ["source", "target", "type"], "left_anti"))
    limit = max(HUB_FACTOR * mean_degree(edges).first()[0], float(HUB_LEAST))
    kept = tabled(_pruned(kept, limit, prunes).select(*columns))
    if isolated(edges, entries).isEmpty():
        return kept
    alone = tabled(isolated(kept, entries))
    pairs = capped(overlap_pairs(entries).filter("jaccard >= 0.05").select("u", "v", F.bround("jaccard", 3).alias("weight")), 1)
    touching = pairs.join(alone, pairs["u"] == alone["id"], "left_semi").unionByName(pairs.join(alone, pairs["v"] == alone["id"], "left_semi")).distinct()
    return kept.unionByName(touching.select(F.col("u").alias("source"), F.col("v").alias("target"), F.lit("overlap").alias("type"), F.lit("undirected").alias("direction"), "weight"))
