"""Answers by stages: each runs on what the one before left open, and on nothing if it left nothing."""

from shelfmark.operators import answers, chunks
from shelfmark.operators.retrieval import name_twins
from shelfmark.schema import ENTRY


def entry(spark, *rows):
    columns = [f.split()[0] for f in ENTRY.split(", ")]
    made = [tuple({"name": n, "type": "skill", "description": d, "triggers": [], "visibility": "ready", "excluded": x}.get(c) for c in columns) for n, d, x in rows]
    return spark.createDataFrame(made, ENTRY).selectExpr("*", "concat_ws(':', type, name) as id", "concat(type, ' ', lower(name)) as ord")


def test_stages(spark):
    entries = entry(spark, ("excel-tool", "reads spreadsheets and formulas", False), ("excel-tool-pro", "formulas in spreadsheets, more of them", False), ("notes", "keeps what was said", False), ("hidden", "secret", True))
    texts = [("notes", "n.md", ["minutes of meetings about zebras"]), ("hidden", "h.md", ["zebras again", "quagga"]), ("excel-tool", "e.md", ["how to sum"])]
    made = chunks.plain_chunks(spark.createDataFrame(texts, "skill string, file string, lines array<string>"))
    edges = spark.createDataFrame([("skill:excel-tool", "skill:notes", 0.8)], "source string, target string, weight double")
    asked = lambda *q: spark.createDataFrame(list(q), "qid long, query string")
    found, refreshed = [], []

    def find(queries, top):
        found.append(sorted(r.qid for r in queries.collect()))
        return chunks.content_search(queries, made, top)

    def refresh(queries):
        refreshed.append(sorted(r.qid for r in queries.collect()))
        return entry(spark, ("okapi-guide", "all about the okapi", False))

    rows = {(r.qid, r.rank): r for r in answers.chat(asked((1, "excel formulas"), (2, "zebras"), (3, "okapi"), (4, "quux")), entries, edges, find=find, refresh=refresh).collect()}
    assert found[0] == [2, 3, 4] and refreshed == [[3, 4]] and found[-1] == [1, 2, 3, 4]
    assert (rows[1, 1].name, rows[1, 1].basis, list(rows[1, 1].twins)) == ("excel-tool", "entries", ["excel-tool-pro"]) and list(rows[1, 1].neighbours) == ["notes"]
    assert rows[1, 2].name == "excel-tool-pro" and "excel-tool" in list(rows[1, 2].neighbours)  # no edge touches it: what shares its terms
    assert (rows[2, 1].name, rows[2, 1].basis, rows[2, 1].weak) == ("notes", "content", True) and (2, 2) not in rows  # hidden is excluded
    assert {"notes / n.md:1-1", "hidden / h.md:1-2"} == set(rows[2, 1].passages)
    assert (rows[3, 1].name, rows[3, 1].basis) == ("okapi-guide", "refreshed") and (rows[4, None].name, rows[4, None].basis) == (None, "open")
    found.clear(), refreshed.clear()
    assert [r.basis for r in answers.answered(asked((1, "excel formulas")), entries, find, refresh).collect()] == ["entries", "entries"]
    assert found == [] and refreshed == []


def test_contents_are_read_once_and_twins_sought_for_hits(spark, monkeypatch):
    entries = entry(spark, ("excel-tool", "reads spreadsheets", False), ("excel-tool-pro", "plots", False), ("notes", "keeps what was said", False), ("notes-old", "", False))
    made = chunks.plain_chunks(spark.createDataFrame([("notes", "n.md", ["zebras"]), ("notes", "n.md", ["zebras"])], "skill string, file string, lines array<string>"))
    terms, read = chunks.chunk_terms, []
    monkeypatch.setattr(chunks, "chunk_terms", lambda: read.append(1) or terms())
    asked = spark.createDataFrame([(1, "spreadsheets"), (2, "zebras"), (3, "quux")], "qid long, query string")
    edges = spark.createDataFrame([], "source string, target string, weight double")
    rows = {(r.qid, r.rank): r for r in answers.chat(asked, entries, edges, made).collect()}
    assert len(read) == 1
    assert {k: (r.name, list(r.twins), list(r.passages)) for k, r in rows.items()} == {(1, 1): ("excel-tool", ["excel-tool-pro"], []), (2, 1): ("notes", ["notes-old"], ["notes / n.md:1-1"]), (3, None): (None, [], [])}
    every = {(r.name, r.twin) for r in name_twins(entries).collect()}
    some = spark.createDataFrame([("notes",), ("excel-tool-pro",)], "name string")
    assert {(r.name, r.twin) for r in name_twins(entries, only=some).collect()} == {x for x in every if x[0] in ("notes", "excel-tool-pro")} != set()
