"""Queries of the catalog engine over a directory of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import manifest
from shelfmark.functions import text as T
from shelfmark.operators import answers, catalog, chunks, content, graph, ledger, reports, retrieval
from shelfmark.oracles import ORACLES
from shelfmark.plans import planner
from shelfmark.schema import PROMOTE_AT, Search
from shelfmark.shared import shared_dir, tabled
from shelfmark.sources import mirror, nearest, tables
from shelfmark.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


LISTED = ("name", "type", "visibility", "excluded", "has_references", "agent_bound")


@query
def catalog_entries(spark, d):
    return tables.entries(spark, d).select("id", *LISTED, F.length("description").alias("description_chars"), F.array_join("triggers", "|").alias("triggers"))


@query
def catalog_list_ready(spark, d):
    return reports.listed(tables.entries(spark, d), kind="skill", with_references=True).select("name", "type", "visibility")


@query
def catalog_lookup(spark, d):
    e = tables.entries(spark, d)
    return reports.lookup(e, e.filter("doc_id % 50 = 7").select(F.upper("name").alias("name")))


@query
def pool_truth_flags(spark, d):
    e, out = tables.entries(spark, d), None
    for flag, options in (("default", Search()), ("off_list", Search(include_off_list=True)), ("agent_only", Search(agent_only=True)), ("all", Search(include_excluded=True))):
        one = retrieval.pool(e, options).select(F.lit(flag).alias("flag"), "name")
        out = one if out is None else out.unionByName(one)
    return out


GLOBS = [("en1*", "first"), ("*-?7", "second"), ("[fd]?2*", "third")]


@query
def exclude_glob(spark, d):
    return reports.excluded_by_globs(tables.entries(spark, d), GLOBS)


@query
def terms_explode(spark, d):
    return graph.entry_terms(tables.entries(spark, d))


@query
def term_df(spark, d):
    return retrieval.document_frequency(graph.entry_terms(tables.entries(spark, d)))


@query
def term_idf(spark, d):
    found = retrieval.pool(tables.entries(spark, d))
    n = found.agg(F.count("*").alias("n"))
    return retrieval.document_frequency(graph.entry_terms(found)).crossJoin(F.broadcast(n)).select("term", F.round(retrieval.idf(F.col("df"), F.col("n")), 6).alias("idf"))


QUESTIONS = [(1, "如何 重算 excel 公式"), (2, "帮我写一个周报"), (3, "为什么 pipeline 失败"), (4, "code review")]


def _asked(spark, d) -> DataFrame:
    """The items of the benchmark as questions, each after one of QUESTIONS."""
    asked = spark.createDataFrame(QUESTIONS, "n bigint, question string")
    return tables.queries(spark, d).withColumn("n", F.col("qid") % len(QUESTIONS) + 1).join(F.broadcast(asked), "n").select("qid", F.concat_ws(" ", "question", "query").alias("query"))


@query
def stop_terms(spark, d):
    return _asked(spark, d).select("qid", F.explode(T.without_stop_words(T.terms(F.col("query")))).alias("term"))


@query
def bridge_terms(spark, d):
    return retrieval.query_terms(_asked(spark, d), T.bridge_table(spark)).select("qid", "term")


GAPS = [(1, "代码审查", ["decision", "review"]), (2, "代码审查", ["代码"]), (3, "code review", ["code"]), (4, "合同管理", ["合同双"]), (5, "合同", [])]


@query
def gap_notice(spark, d):
    """Whether the evidence of entries, as one of GAPS has it beside their triggers, leaves a question's CJK terms open."""
    gaps = spark.createDataFrame(GAPS, "n bigint, question string, found array<string>")
    rows = tables.entries(spark, d).withColumn("n", F.col("doc_id") % len(GAPS) + 1).join(F.broadcast(gaps), "n")
    evidence = F.concat("found", F.when(F.col("n") == 5, T.none()).otherwise(F.col("triggers")))
    return rows.select("id", T.uncovered_gap(F.concat_ws(" ", "question", F.array_join("triggers", " ")), evidence, F.size(evidence)).alias("gap"))


@query
def list_mirror(spark, d):
    """Names and kinds of the documents that mirror a list, after it changed once: what was kept, and what was written."""
    e, store = tables.entries(spark, d), Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    marks = F.element_at(F.array(*map(F.lit, "/:?")), (F.col("doc_id") % 3 + 1).cast("int"))
    items = e.select("doc_id", F.concat("source", marks, F.expr("cast(doc_id div 9 as string)")).alias("name"), "description", F.when(F.col("has_references"), F.col("full_text")).alias("body"), F.col("doc_id").alias("ord"))
    mirror.mirror(store, items.withColumn("description", F.when(F.col("doc_id") % 4 == 0, "before").otherwise(F.col("description"))).drop("doc_id"))
    return mirror.mirror(store, items.drop("doc_id"))[1]


@query
def search_candidates(spark, d):
    _, rows, heads = retrieval.entry_candidates(tables.queries(spark, d), tables.entries(spark, d))
    rows = rows().join(heads, "k")
    return rows.groupBy("qid", "name").agg(F.count("*").alias("n_terms"), F.min("loc").cast("int").alias("best_place"))


@query
def search_evidence(spark, d):
    return retrieval.scored(tables.queries(spark, d), tables.entries(spark, d)).select("qid", "name", "score", "ev", F.array_join(F.array_sort("evidence"), " ").alias("evidence"))


@query
def search_topk(spark, d):
    return retrieval.search(tables.queries(spark, d), tables.entries(spark, d)).select("qid", "rank", "name", "score")


@query
def search_ties(spark, d):
    return retrieval.search(tables.queries(spark, d), tables.entries(spark, d)).filter("tied").select("qid", "rank", "name")


@query
def single_char_search(spark, d):
    q = spark.createDataFrame([(1, "q"), (2, "Z"), (3, "7")], "qid bigint, query string")
    return retrieval.single_character(q, tables.entries(spark, d))


@query
def name_twins(spark, d):
    e = tables.entries(spark, d)
    short = e.filter("doc_id % 12 = 0").withColumn("name", F.substring_index("name", "-", 1)).withColumn("ord", F.concat("type", F.lit(" "), F.lower("name")))
    return retrieval.name_twins(e.unionByName(short))


@query
def overlap_candidates(spark, d):
    return graph.overlap_candidates(tables.entries(spark, d)).withColumn("weight", F.round("weight", 3))


@query
def overlap_edges_capped(spark, d):
    return graph.capped(graph.overlap_candidates(tables.entries(spark, d)).select("u", "v", "weight"))


@query
def family_edges(spark, d):
    return graph.family_edges(tables.entries(spark, d))


@query
def contains_edges(spark, d):
    return graph.contains_edges(tables.entries(spark, d))


def _with_references(e: DataFrame) -> DataFrame:
    """Entries whose descriptions name entry i div 2, and what is no whole name, at their start."""
    named = e.select(F.col("doc_id").alias("_k"), F.col("name").alias("_n"))
    both = e.join(named, F.expr("doc_id div 2") == F.col("_k"))
    return both.withColumn("description", F.concat(F.lit("uses "), F.when(F.col("doc_id") % 3 == 0, F.concat("_n", F.lit("x"))).otherwise(F.col("_n")), F.lit(". "), "description")).drop("_k", "_n")


@query
def name_refs(spark, d):
    return graph.name_references(_with_references(tables.entries(spark, d))).select("source", "target")


def _files(spark, d) -> DataFrame:
    lines = tables.read(spark, d, "documents")
    return lines.select("source", "doc_id", F.col("source").alias("skill"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.split("text", "\n").alias("lines"))


@query
def similar_pairs(spark, d):
    posted = tables.entries(spark, d).select(F.col("name").alias("skill"), F.explode(T.terms(F.col("description"))).alias("term"))
    return graph.similar_pairs(posted)


def _every_kind(e: DataFrame) -> DataFrame:
    """Edges of all five kinds, overlap and similar ones capped; similar ones are of the terms of skills' chunks."""
    files = e.filter("type = 'skill'").select(F.col("name").alias("skill"), F.concat("name", F.lit(".txt")).alias("file"), F.split("full_text", "\n").alias("lines"))
    similar = graph.similar_edges(chunks.chunk_postings(chunks.plain_chunks(files)), e)
    return graph.all_edges(e, graph.capped(graph.overlap_candidates(e).select("u", "v", "weight")), similar)


def _edges(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entries, and their family, contains and dependency edges."""
    e = tables.entries(spark, d)
    return e, graph.family_edges(e).unionByName(graph.contains_edges(e)).unionByName(tables.dependencies(e))


def _all_kinds(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entries, and edges of all five kinds with the scenario's dependencies: written, as they are read both ways and more than once."""
    e = tables.entries(spark, d)
    return e, tabled(_every_kind(e).unionByName(tables.dependencies(e)).dropDuplicates(["source", "target", "type"]))


@query
def all_edges(spark, d):
    """Without similar edges, and with overlap edges as they are before they are capped, as SQL can say them."""
    e = tables.entries(spark, d)
    return graph.all_edges(e, graph.overlap_candidates(e)).withColumn("weight", F.round("weight", 3))


@query
def all_edges_five_kinds(spark, d):
    return _every_kind(tables.entries(spark, d))


@query
def graph_hubs_five_kinds(spark, d):
    return graph.hubs(_all_kinds(spark, d)[1])


@query
def related_five_kinds(spark, d):
    e, edges = _all_kinds(spark, d)
    return graph.related(edges, e)


@query
def collaborators(spark, d):
    e = tables.entries(spark, d)
    return retrieval.collaborators(e, graph.family_edges(e))


@query
def search_report(spark, d):
    e, edges = _edges(spark, d)
    return retrieval.report(tables.queries(spark, d), e, edges).select("qid", "rank", "name", "score", "tied", F.array_join("twins", " ").alias("twins"), F.array_join("neighbours", " ").alias("neighbours"), "gap")


@query
def related_top5(spark, d):
    e, edges = _edges(spark, d)
    return graph.related(edges, e)


@query
def one_hop(spark, d):
    e, edges = _edges(spark, d)
    return graph.neighbours(edges, e).select("node", "other", "type", "weight", "name")


@query
def impact_two_hop(spark, d):
    return graph.impact(_edges(spark, d)[1])


@query
def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d)[1])


@query
def graph_isolated(spark, d):
    e = tables.entries(spark, d)
    return graph.isolated(graph.family_edges(e), e)


@query
def graph_conflicts(spark, d):
    deps = tables.dependencies(tables.entries(spark, d))
    back = deps.filter(F.length("source") % 4 == 0).select(F.col("target").alias("source"), F.col("source").alias("target"), "type", "direction", "weight")
    return graph.conflicts(deps.unionByName(back))


@query
def graph_hubs(spark, d):
    return graph.hubs(_edges(spark, d)[1])


@query
def graph_dangling(spark, d):
    e = tables.entries(spark, d)
    return graph.dangling(graph.contains_edges(e), e.filter("doc_id % 9 <> 0"))


@query
def graph_repair(spark, d):
    e, edges = _all_kinds(spark, d)
    return graph.repaired(edges, e.filter("doc_id % 9 <> 0"), prunes=None)


@query
def plain_chunks(spark, d):
    return chunks.plain_chunks(_files(spark, d)).select("skill", "file", "s", "e", "summary", F.length("text").alias("chars"))


@query
def chunk_postings(spark, d):
    return chunks.chunk_postings(chunks.plain_chunks(_files(spark, d))).groupBy("term").agg(F.count("*").alias("n"))


@query
def content_search(spark, d):
    return chunks.content_search(tables.queries(spark, d), chunks.plain_chunks(_files(spark, d)))


@query
def markdown_chunks(spark, d):
    files = _files(spark, d).withColumn("lines", F.transform("lines", lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("## "), x)).otherwise(x)))
    return chunks.markdown_chunks(files).select("skill", "file", "s", "e", "summary")


@query
def python_chunks(spark, d):
    """Each text as the comments of a small program, which every fifth time does not parse."""
    words = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("# "), F.regexp_replace(x, "[^ -~]", "")))
    code = F.expr("array('', concat('def f_', cast(doc_id as string), '(x):'), '    a = x', '    b = a', '    c = b', '    return c', 'y = 1', if(doc_id % 5 = 0, 'def broken(', 'z = 2'))")
    files = tables.read(spark, d, "documents").select(F.col("source").alias("skill"), F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.concat(F.array(F.lit("import os")), words, code).alias("lines"))
    return chunks.python_chunks(files).select("skill", "file", "s", "e", "summary")


@query
def python_text_chunks(spark, d):
    """The texts' own lines, most of which do not parse."""
    return chunks.python_chunks(_files(spark, d).select("skill", F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), "lines")).select("skill", "file", "s", "e", "summary")


@query
def file_outline(spark, d):
    return chunks.outline(chunks.plain_chunks(_files(spark, d))).withColumn("sections", F.array_join("sections", "\n"))


@query
def coverage(spark, d):
    return reports.coverage(tables.entries(spark, d))


@query
def coverage_rollup(spark, d):
    return reports.coverage_by(tables.entries(spark, d), "rollup", "type", "visibility").withColumn("level", F.col("level").cast("bigint"))


@query
def coverage_cube(spark, d):
    return reports.coverage_by(tables.entries(spark, d), "cube", "source", "type").withColumn("level", F.col("level").cast("bigint"))


@query
def token_economy(spark, d):
    return reports.token_economy(tables.entries(spark, d))


@query
def dense_lines(spark, d):
    return reports.dense_lines(tables.entries(spark, d))


@query
def heaviest_entries(spark, d):
    return reports.heaviest(tables.entries(spark, d))


@query
def doctor_findings(spark, d):
    e = tables.entries(spark, d)
    twice = e.filter("doc_id % 97 = 3").withColumn("type", F.lit("mcp"))
    return reports.doctor(e.unionByName(twice))


def _snapshots(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = e.select("doc_id", F.col("name").alias("path"), F.length("full_text").cast("bigint").alias("mtime"))
    return rows.filter("doc_id % 10 <> 1"), rows.filter("doc_id % 10 <> 2").withColumn("mtime", F.when(F.col("doc_id") % 10 == 3, F.col("mtime") + 1).otherwise(F.col("mtime")))


@query
def merge_incremental(spark, d):
    old, new = _snapshots(tables.entries(spark, d))
    return catalog.incremental(old, new)


@query
def merge_registry(spark, d):
    e = tables.entries(spark, d)
    registry = e.filter("visibility <> 'off-list'").withColumn("description", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("description")))
    disk = e.filter("doc_id % 5 <> 0").withColumn("description", F.col("description"))
    return catalog.merge_registry(registry, disk)


@query
def upsert_import(spark, d):
    e = tables.entries(spark, d).select("doc_id", "name", F.col("description").alias("description"), F.col("source").alias("path"), "triggers")
    new = e.filter("doc_id % 3 <> 0").withColumn("description", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("new "), "description")).otherwise(F.col("description")))
    return catalog.upsert(e.filter("doc_id % 4 <> 0"), new).select("name", "description", "path", "change")


@query
def registry_backfill(spark, d):
    e = tables.entries(spark, d).select("doc_id", "name", F.col("description").alias("description"), F.col("source").alias("category"), F.lit(None).cast("string").alias("platform"), F.col("visibility").alias("status"))
    old = e.filter("doc_id % 4 <> 0").withColumn("agents", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(T.none()))
    new = e.filter("doc_id % 3 = 0").withColumn("agents", F.array(F.lit("b"), F.lit("c"))).withColumn("category", F.lit(""))
    return catalog.backfill(old, new).select("name", "description", "category", "status", F.array_join("agents", ",").alias("agents"))


@query
def variants(spark, d):
    e = tables.entries(spark, d)
    off = e.filter("doc_id % 6 = 1").withColumn("name", F.concat("name", F.lit("-v2")))
    return catalog.variants(e.filter("visibility = 'ready'"), off)


def _listed(e: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """A list and a disk of two moments: entries come, change and go, and move between them; some of the disk have names of bases."""
    on = e.filter(f"visibility <> 'off-list' and doc_id % 10 <> {run}")
    rewritten = F.when((F.col("doc_id") % 10 == 5) & F.lit(run == 2), F.concat("description", F.lit(" rewritten"))).otherwise(F.col("description"))
    listed = on.select("name", rewritten.alias("description"), "triggers", "ord", F.when(F.col("visibility") == "ready", "ready").otherwise("blocked").alias("visibility"))
    disk = e.filter(f"doc_id % 7 <> {run}").withColumn("name", F.when(F.col("doc_id") % 6 == 1, F.concat("name", F.lit("-v2"))).otherwise(F.col("name")))
    mtime = F.length("full_text").cast("bigint") + F.when((F.col("doc_id") % 11 == 3) & F.lit(run == 2), 1).otherwise(0)
    return listed, disk.select("name", "description", "triggers", F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), mtime.alias("mtime"), "ord")


@query
def chat_answers(spark, d):
    """Answers by stages to the items of the benchmark, over entries that name and triggers alone describe; contents are of all."""
    e, edges = _edges(spark, d)
    files = e.filter("type = 'skill'").select(F.col("name").alias("skill"), F.concat("name", F.lit(".txt")).alias("file"), F.split("full_text", "\n").alias("lines"))
    rows = answers.chat(tables.queries(spark, d), e.withColumn("description", F.lit("")), edges.select("source", "target", "weight"), chunks.plain_chunks(files))
    return rows.select("qid", "rank", "name", "score", "basis", "weak", "gap", *[F.array_join(c, "|").alias(c) for c in ("twins", "neighbours", "passages")])


@query
def nearest_documents(spark, d):
    """Of entities in folders of ten the document nearest to each: a skill of its name, its folder's readme, the package above."""
    docs = tables.read(spark, d, "documents")
    n, folder = F.col("doc_id"), F.concat(F.lit("/r/"), F.expr("cast(doc_id div 100 as string)"), F.lit("/"), F.expr("cast(doc_id div 10 as string)"))
    name = F.concat("lang", F.col("doc_id").cast("string"))
    entities = docs.select("doc_id", name.alias("name"), F.concat(folder, F.lit("/conf.json")).alias("path"))
    skill = docs.filter(n % 10 == 2).select(F.concat(folder, F.lit("/skills/"), name, F.lit("/SKILL.md")).alias("path"), F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: >\n  the skill\n  of "), name, F.lit("\n---\n")).alias("text"))
    readme = docs.filter((n % 10 == 0) & (n % 30 == 0)).select(F.concat(folder, F.lit("/README.md")).alias("path"), "text")
    package = docs.filter(n % 100 == 5).select(F.concat(F.lit("/r/"), F.expr("cast(doc_id div 100 as string)"), F.lit("/package.json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("package "), name).alias("description"))).alias("text"))
    found = nearest.nearest(entities, nearest.described(skill.unionByName(readme).unionByName(package)))
    return found.select("doc_id", "name", "found", "found_description")


@query
def synthesized_triggers(spark, d):
    e = tables.entries(spark, d)
    name, said = F.concat("name", F.lit("_Extra"), F.element_at("triggers", 1)), F.concat(F.lit("Use when: "), F.array_join(F.reverse("triggers"), ", "), F.lit(". And so on"))
    rows = e.filter(F.size("triggers") > 0).select("id", name.alias("name"), said.alias("said"), F.transform("triggers", lambda t: F.concat(F.lit(" "), F.initcap(t))).alias("declared"))
    return rows.select("id", F.array_join(T.synthesized_triggers(F.col("name"), F.col("said"), F.slice("declared", 1, 2)), "|").alias("triggers"))


@query
def cross_feed(spark, d):
    """Sections of documents about the language of their source, fed to sources by what they depend on, within both budgets."""
    files = _files(spark, d).withColumn("file", F.when(F.col("doc_id") % 50 == 0, F.concat("skill", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/SKILL.md"))).otherwise(F.col("file")))
    made = chunks.plain_chunks(files, 12, 0).withColumn("text", F.concat(F.lit("usage: "), "text"))
    n = F.expr("cast(substring(source, 4) as int)")
    sources = tables.read(spark, d, "documents").select("source").distinct()
    edges = sources.select("source", F.explode(F.array(n + 1, n + 2)).alias("n")).select("source", F.concat(F.lit("src"), F.col("n").cast("string")).alias("target"), F.when(F.col("n") % 2 == 0, "contains").otherwise("depends_on").alias("type"))
    return chunks.cross_feed(edges, made).select("skill", "file", "s", "e", "fed_from")


@query
def front_matter(spark, d):
    """Fields of manifests that are written about all documents: blocks folded and literal, a quoted line, and none at all."""
    kind, lines = F.col("doc_id") % 4, F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")), lambda x: x != "")
    block = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n  "), x)), "")
    value = F.when(kind == 0, F.concat(F.lit(" >-"), block)).when(kind == 1, F.concat(F.lit(" |"), block)).otherwise(F.concat(F.lit(' "'), F.translate(F.element_at("lines", 1), "\"'\\", ""), F.lit('"')))
    rows = tables.read(spark, d, "documents").withColumn("lines", lines).filter(F.size("lines") > 0)
    text = F.when(kind == 3, F.concat(F.lit("## About\n\n# Entry "), "doc_id", F.lit("\n"))).otherwise(F.concat(F.lit("---\nname: 'entry "), "doc_id", F.lit("'\nmeta:\n  a: b\ndescription:"), value, F.lit("\n---\n# *Entry* "), "doc_id", F.lit("\n")))
    return rows.select("doc_id", manifest.fields(text).alias("m")).select("doc_id", "m.name", "m.description", "m.h1")


@query
def reconcile(spark, d):
    """The second of two runs over a list and a disk that changed between them, the index kept in generations."""
    e, store = tables.entries(spark, d), Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    last = store.commit(store.current(), {"index": catalog.reconcile(*_listed(e, 1))})
    done = store.commit(last, {"index": catalog.reconcile(*_listed(e, 2), store.read(last, "index"))})
    return store.read(done, "index").select("name", "origin", "visibility", "excluded", "variant_of", "change")


@query
def index_generations(spark, d):
    """Entries that two generations of an index have, as a reader of the first sees them beside one of the second."""
    e, store = tables.entries(spark, d), Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    some = e.filter("doc_id % 3 <> 0")
    first = store.commit(store.current(), {"entries": some.select("id", "type", "visibility"), "edges": graph.family_edges(some).select("source", "target")})
    second = store.commit(first, {"entries": e.select("id", "type", "visibility"), "edges": graph.family_edges(e).select("source", "target")})
    out = None
    for g in (first, store.current()):
        degree = store.read(g, "edges").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("edges"))
        one = store.read(g, "entries").join(degree, "id", "left").select(F.lit(g.number - first.number + 1).cast("bigint").alias("generation"), "id", "type", "visibility", F.coalesce("edges", F.lit(0)).alias("edges"))
        out = one if out is None else out.unionByName(one)
    assert second.number == first.number + 1
    return out


def _file_states(spark, d) -> list[DataFrame]:
    """Files at three moments; the last is of all documents. A fourth of them comes late, a fourth changes, others go."""
    files, kind = _files(spark, d), F.col("doc_id") % 4
    lines = F.when(kind == 1, F.reverse("lines")).otherwise(F.col("lines"))
    first = files.filter(kind != 3).select("skill", F.when(kind == 2, F.concat("file", F.lit(".old"))).otherwise(F.col("file")).alias("file"), F.lit(1).cast("bigint").alias("mtime"), lines.alias("lines"))
    second = files.filter((kind != 3) | (F.col("doc_id") % 8 == 3)).select("skill", "file", F.when(kind == 1, 2).otherwise(1).cast("bigint").alias("mtime"), "lines")
    return [first, second, files.select("skill", "file", F.when(kind == 1, 2).otherwise(1).cast("bigint").alias("mtime"), "lines")]


def _updated(spark, d) -> tuple[Store, object, list[DataFrame]]:
    store, told, index = Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"), [], None
    for files in _file_states(spark, d):
        index, counts = content.update(store, files, chunks.plain_chunks, most=1 << 30)
        told.append(counts)
    return store, index, told


@query
def content_update(spark, d):
    """What each of three updates of a kept content index changed, of each kind how many files."""
    _, _, told = _updated(spark, d)
    out = None
    for i, counts in enumerate(told, 1):
        one = counts.select(F.lit(i).cast("bigint").alias("run"), "change", F.col("count").alias("files"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def content_frequencies(spark, d):
    """Document frequencies of a content index that was updated twice, kept by adding and subtracting."""
    store, index, _ = _updated(spark, d)
    return content.frequencies(store, index).select("term", F.col("df").alias("n"))


@query
def content_search_kept(spark, d):
    """content_search over an index that was updated twice."""
    store, index, _ = _updated(spark, d)
    return content.search(store, index, tables.queries(spark, d))


@query
def catalog_fingerprint(spark, d):
    return catalog.fingerprint(tables.entries(spark, d))


@query
def ledger_gap(spark, d):
    return ledger.gaps(tables.hit_events(spark, d))


@query
def ledger_hits(spark, d):
    return ledger.hits(tables.hit_events(spark, d))


@query
def ledger_adopt(spark, d):
    return ledger.adoptions(tables.hit_events(spark, d))


@query
def ledger_zombies(spark, d):
    names = spark.range(0, 200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"))
    return ledger.zombies(names, tables.hit_events(spark, d))


@query
def promotion(spark, d):
    return ledger.promotions(tables.hit_events(spark, d), ["k1", "k2"], PROMOTE_AT)


@query
def usage_summary(spark, d):
    return ledger.usage(tables.hit_events(spark, d).select(F.col("kind").alias("cmd"), F.floor("value").cast("bigint").alias("chars")))


@query
def ledger_tumbling(spark, d):
    return ledger.windows(tables.hit_events(spark, d), "1 day")


@query
def ledger_sliding(spark, d):
    return ledger.windows(tables.hit_events(spark, d), "2 days", "1 day")


@query
def ledger_session(spark, d):
    return ledger.sessions(tables.hit_events(spark, d), "6 hours")


@query
def route_intents(spark, d):
    rows = tables.read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(F.element_at(F.array(*map(F.lit, ("find ", "export the ", "plan for ", "what is ", "@alpha "))), (F.pmod(F.col("conv_id"), F.lit(5)) + 1).cast("int")), F.col("text")).alias("text"))
    return planner.route(rows).select("conv_id", "turn", "command", F.array_join("alternatives", ",").alias("alternatives"))


@query
def dag_layers(spark, d):
    e = tables.entries(spark, d)
    return planner.layers(e.select(F.lit(1).alias("task"), "id"), tables.dependencies(e)).select("id", F.col("layer").cast("bigint").alias("layer"), "cyclic")


@query
def pipeline_stages(spark, d):
    e = tables.entries(spark, d)
    return planner.plan(tables.queries(spark, d), e, tables.dependencies(e))


#: Words that entries are named by for lifecycle_stages, as the tables' own names have none of process.
STAGE_WORDS = ("plan", "docs", "code", "test", "debug", "refactor", "cleanup", "review", "audit", "archive", "feature", "guide", "zebra")


@query
def lifecycle_stages(spark, d):
    tasks = spark.createDataFrame([(1, "develop a feature module"), (2, "write a letter"), (3, "fix the zebra tool")], "qid bigint, query string")
    e, words = tables.entries(spark, d), F.array(*map(F.lit, STAGE_WORDS))
    word = lambda n: F.get(words, (n % len(STAGE_WORDS)).cast("int"))
    e = e.withColumn("name", F.when(F.col("doc_id") % 3 == 0, F.concat(word(F.col("doc_id")), F.lit("-"), word(F.expr("doc_id div 13")))).otherwise(F.col("name")))
    e = e.withColumns({"id": F.concat_ws(":", "type", "name"), "ord": F.concat("type", F.lit(" "), F.lower("name"))})
    return planner.lifecycle(tasks, e, {"审查把关": "review-code"})
