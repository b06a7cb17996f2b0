"""Chunking of files by lines, chunk postings, content search and cross-feeding."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from shelfmark.functions import text as T
from shelfmark.operators.retrieval import MOST_WANTED, Rows, candidates, numbered, shortlist, with_plan
from shelfmark.schema import CHUNK_LINES, CHUNK_MIN_LINES, CHUNK_OVERLAP, CHUNK_SUMMARY, CHUNKS_PER_SKILL, FED_FILES, FED_PER_SKILL
from shelfmark.shared import tabled

CHUNK_KEYS = ("skill", "file", "s", "e")

#: Words that mark a section worth feeding to dependents; replaceable.
KEY_SECTION = r"(?i)\b(usage|example|quick ?start|install|api|parameters?|options?|config(uration)?|overview|workflow|rules?|constraints?|output|input)\b|用法|示例|参数|配置|流程|规则"


def _summary(lines: Column) -> Column:
    first = F.get(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return F.left(F.coalesce(first, F.lit("")), F.lit(CHUNK_SUMMARY))


def _text(start: Column, end: Column) -> Column:
    return F.array_join(F.slice("lines", start, end - start + 1), "\n")


def plain_chunks(files: DataFrame, length: int = CHUNK_LINES, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of lines of each file (skill, file, lines): skill, file, s, e, summary, text; s and e count from 1."""
    n, step = F.size("lines"), length - overlap
    last = F.when(n <= length, 0).otherwise(F.ceil((n - length) / step)).cast("int")
    rows = files.filter(F.exists("lines", lambda x: F.trim(x) != "")).withColumn("w", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("s", F.col("w") * step + 1).withColumn("e", F.least(F.col("w") * step + length, n))
    return rows.select("skill", "file", "s", "e", _summary(F.slice("lines", F.col("s"), F.col("e") - F.col("s") + 1)).alias("summary"), _text(F.col("s"), F.col("e")).alias("text"))


def markdown_chunks(files: DataFrame, least: int = CHUNK_MIN_LINES) -> DataFrame:
    """Segments from heading to heading outside closed fences; a segment shorter than `least` joins the one before."""
    fence = lambda x: F.startswith(F.ltrim(x), F.lit("```"))
    fences = F.size(F.filter("lines", fence))
    state = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("heads"))

    def step(a, x):
        masked = (a["seen"] % 2 == 1) & ((a["seen"] < fences) | (fences % 2 == 0))
        head = x.rlike("^#{1,6}\\s") & ~masked
        return F.struct((a["seen"] + fence(x).cast("int")).alias("seen"), (a["i"] + 1).alias("i"), F.when(head, F.concat(a["heads"], F.array(a["i"] + 1))).otherwise(a["heads"]).alias("heads"))

    rows = files.filter(F.exists("lines", lambda x: F.trim(x) != "")).withColumn("heads", F.aggregate("lines", state, step)["heads"])
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), "heads"))
    n = F.size("lines")
    rows = rows.withColumn("starts", starts)
    ends = F.transform("starts", lambda s, i: F.coalesce(F.get("starts", i + 1) - 1, n))
    rows = rows.withColumn("segments", F.zip_with("starts", ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    none = F.array().cast("array<struct<s:int,e:int>>")
    merged = F.aggregate("segments", none, lambda done, x: F.when(
        (F.size(done) > 0) & (x["e"] - x["s"] + 1 < least),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), x["e"].alias("e"))))).otherwise(F.concat(done, F.array(x))))
    rows = rows.withColumn("m", F.explode(merged)).select("skill", "file", "lines", "m.s", "m.e")
    own = F.slice("lines", F.col("s"), F.col("e") - F.col("s") + 1)
    return rows.select("skill", "file", "s", "e", _summary(F.transform(own, lambda x: F.regexp_replace(x, "^#{1,6}\\s+", ""))).alias("summary"), _text(F.col("s"), F.col("e")).alias("text"))


@udtf(returnType="s int, e int, summary string")
class PythonSegments:
    """Top-level definitions and assignments of a Python file, each a segment by its name or first line; what stands before
    the first is one too, and a segment shorter than the least joins the one before. A file without any is one segment; one
    that does not parse has no row."""

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        lines = (source or "").split("\n")

        def said(first: int, last: int) -> str:
            return next((x.strip() for x in lines[first - 1 : last] if x.strip()), "")[:CHUNK_SUMMARY]

        marks = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assign))]
        if not marks:
            yield 1, len(lines), said(1, len(lines))
            return
        parts: list[list] = []
        if marks[0].lineno > 1 and said(1, marks[0].lineno - 1):
            parts.append([1, marks[0].lineno - 1, said(1, marks[0].lineno - 1)])
        for node, after in zip(marks, [*marks[1:], None]):
            last = min(node.end_lineno, len(lines), after.lineno - 1 if after else len(lines))
            if parts and last - node.lineno + 1 < CHUNK_MIN_LINES:
                parts[-1][1] = last
            else:
                parts.append([node.lineno, last, getattr(node, "name", "")[:CHUNK_SUMMARY] or said(node.lineno, last)])
        for s, e, summary in parts:
            yield s, e, summary


def python_chunks(files: DataFrame) -> DataFrame:
    """Definitions of files that parse, windows of lines of those that don't; blank files have no chunk."""
    spark = files.sparkSession
    spark.udtf.register("shelfmark_python_segments", PythonSegments)
    view = "shelfmark_python_files"
    files.filter(F.exists("lines", lambda x: F.trim(x) != "")).withColumn("source", F.array_join("lines", "\n")).createOrReplaceTempView(view)
    found = spark.sql(f"SELECT f.skill, f.file, f.lines, t.s, t.e, t.summary FROM {view} f, LATERAL shelfmark_python_segments(f.source) t")
    found = found.select("skill", "file", "s", "e", "summary", _text(F.col("s"), F.col("e")).alias("text"))
    rest = files.join(found.select("skill", "file").distinct(), ["skill", "file"], "left_anti")
    return found.unionByName(plain_chunks(rest))


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks by file extension, each once, and at most so many of a skill in order of file and line."""
    low = F.lower("file")
    every = markdown_chunks(files.filter(low.endswith(".md"))).unionByName(python_chunks(files.filter(low.endswith(".py")))).unionByName(plain_chunks(files.filter(~low.endswith(".md") & ~low.endswith(".py"))))
    once = every.dropDuplicates(["skill", "file", "s", "e"])
    return once.withColumn("r", F.row_number().over(Window.partitionBy("skill").orderBy("file", "s", "e"))).filter(F.col("r") <= CHUNKS_PER_SKILL).drop("r")


def chunk_postings(chunks: DataFrame) -> DataFrame:
    return chunks.select("skill", "file", "s", "e", F.explode(chunk_terms()).alias("term"))


def content_plan(queries: DataFrame) -> DataFrame:
    """qid, terms, coverers of each query without stop words; a term is covered by those that hold it."""
    rows = queries.select("qid", "query", F.explode(T.without_stop_words(T.terms(F.col("query")))).alias("term"))
    return T.asked(rows, lambda t, o, low: (o != t) & F.contains(o, t))


def chunk_terms() -> Column:
    return T.terms(T.joined(F.col("summary"), F.col("file"), F.col("skill"), F.col("text")))


def content_search(queries: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """qid, rank, skill, file, s, e, score: chunks by uncapped weights of maximal terms, +2 for one in the file's name, +0.5 if fed."""
    return content_finder(chunks, queries)(queries, top)


def content_finder(chunks: DataFrame, queries: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """content_search of queries, or of some of them, as often as wanted: chunks are read and tokenised once, at the first call.

    Of a chunk only the terms that queries ask for are written, and one row without a term.
    """
    kept: list[tuple[DataFrame, DataFrame]] = []

    def read() -> tuple[DataFrame, DataFrame]:
        """Postings (k, term) and heads (k, CHUNK_KEYS, fed) of all chunks."""
        fed = F.col("fed_from").isNotNull() if "fed_from" in chunks.columns else F.lit(False)
        rows = chunks.withColumn("fed", fed)
        wanted = tabled(content_plan(queries).select(F.explode("terms").alias("term")).distinct().withColumn("asked", F.lit(True)))
        if wanted.count() > MOST_WANTED:
            heads = numbered(rows, (*CHUNK_KEYS, "fed"), chunk_terms())
            return heads.select("k", F.explode("terms").alias("term")), heads.drop("terms")
        rows = rows.select(*CHUNK_KEYS, "fed", F.array_append(chunk_terms(), F.lit(None).cast("string")).alias("terms")).withColumn("k", F.monotonically_increasing_id())
        rows = rows.select("k", *CHUNK_KEYS, "fed", F.explode("terms").alias("term"))
        rows = tabled(rows.join(F.broadcast(wanted), "term", "left").filter("term is null or asked").drop("asked"))
        return rows.filter("term is not null").select("k", "term"), rows.filter("term is null").drop("term")

    def find(some: DataFrame, top: int = 5) -> DataFrame:
        if not kept:
            kept.append(read())
        posted, heads = kept[0]
        asked = tabled(content_plan(some))
        return content_hits(asked, candidates(asked, posted, heads.agg(F.count("*").alias("n"))), heads, top)

    return find


def content_hits(asked: DataFrame, rows: Rows, heads: DataFrame, top: int = 5) -> DataFrame:
    """content_search, from candidates (k, qid, pos, idf) and heads (k, CHUNK_KEYS, fed)."""

    def exact(pairs: DataFrame) -> DataFrame:
        found = with_plan(rows(pairs).groupBy("qid", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "idf"))).alias("overlap")), asked).join(heads, "k")
        found = found.withColumn("kept", T.uncovered("overlap", "coverers"))
        in_file = F.arrays_overlap(F.transform("kept", lambda x: F.get("terms", x["pos"])), T.terms(F.col("file")))
        score = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x["idf"]) + F.when(in_file, 2.0).otherwise(0.0) + F.when(F.col("fed"), 0.5).otherwise(0.0)
        return found.select("qid", "k", *CHUNK_KEYS, F.round(score, 6).alias("score"))

    pairs = rows().groupBy("qid", "k").agg((F.sum("idf") + 2.5).alias("bound"))
    found = exact(shortlist(pairs, exact, top)).dropDuplicates(["qid", *CHUNK_KEYS])
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), *CHUNK_KEYS))).filter(F.col("rank") <= top).select("qid", "rank", *CHUNK_KEYS, "score")


def cross_feed(edges: DataFrame, chunks: DataFrame, most: int = FED_PER_SKILL, files: int = FED_FILES, entries: DataFrame | None = None) -> DataFrame:
    """Key sections of what a skill depends on, contains or is contained in, as chunks of it; edges by skill name.

    Budgets: of a dependency its main file (skill.md) and the first `files` others by name; of a skill `most` sections in all,
    dealt to its dependencies in order of their names, to a dependency's files in that order, and to a file's sections from the
    top, so what one leaves over goes on to the next. Of dependencies that are connectors without files (entries: name, type,
    description) the description is a section.
    """
    d = edges.filter(F.col("type").isin("depends_on", "contains")).select(F.col("source").alias("to"), F.col("target").alias("skill"))
    d = d.unionByName(edges.filter("type = 'contains'").select(F.col("target").alias("to"), F.col("source").alias("skill"))).filter("to <> skill").distinct()
    main = F.lower("file").rlike("(^|/)skill\\.md$")
    own = chunks.filter(F.col("text").rlike(KEY_SECTION)).withColumn("_main", main.cast("int"))
    # The first budget is of a dependency alone, so its sections are cut before they are dealt to all that depend on it.
    own = own.withColumn("_f", F.dense_rank().over(Window.partitionBy("skill", "_main").orderBy("file"))).filter((F.col("_main") == 1) | (F.col("_f") <= files))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("_main"), "file", "s"))).filter(F.col("_n") <= most)
    own = own.select(*CHUNK_KEYS, "summary", "text", "_n")
    if entries is not None:
        told = entries.filter("type = 'mcp' and description <> ''").join(chunks.select(F.col("skill").alias("name")).distinct(), "name", "left_anti")
        own = own.unionByName(told.select(F.col("name").alias("skill"), F.concat(F.lit("MCP@"), "name").alias("file"), F.lit(1).alias("s"), F.lit(1).alias("e"), F.left("description", F.lit(CHUNK_SUMMARY)).alias("summary"), F.col("description").alias("text"), F.lit(1).alias("_n")))
    ranked = own.join(d, "skill").withColumn("r", F.row_number().over(Window.partitionBy("to").orderBy("skill", "_n"))).filter(F.col("r") <= most)
    return ranked.select(F.col("to").alias("skill"), "file", "s", "e", "summary", "text", F.col("skill").alias("fed_from"))


def outline(chunks: DataFrame, most: int = 8) -> DataFrame:
    """skill, file, n, sections: of each file how many chunks it has and the first `most` of them, as lines and summary."""
    line = F.concat(F.lit("L"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"), F.lit(": "), "summary")
    ranked = chunks.withColumn("r", F.row_number().over(Window.partitionBy("skill", "file").orderBy("s", "e"))).withColumn("line", line)
    first = F.collect_list(F.when(F.col("r") <= most, F.struct("r", "line")))
    return ranked.groupBy("skill", "file").agg(F.count("*").alias("n"), F.transform(F.array_sort(first), lambda x: x["line"]).alias("sections"))


def register(spark: SparkSession) -> None:
    """SQL functions: shelfmark_python_segments as a table function."""
    spark.udtf.register("shelfmark_python_segments", PythonSegments)
