"""Nearest documents by path, and triggers out of three sources."""

import json

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.sources import nearest

TEXTS = "path string, text string"


def test_nearest_folder_and_first_place(spark):
    skill = "---\nname: x\ndescription: from a skill\n---\n"
    texts = [
        ("/a/b/README.md", "#\n![badge]\n[link]\nshort\n## Says what it is\nmore"), ("/a/b/skills/one/SKILL.md", skill), ("/a/package.json", json.dumps({"description": "", "summary": "a package", "keywords": ["k", "l"]})),
        ("/a/b/skill/SKILL.md", "# only a title"), ("/c/readme.md", "nothing\n"), ("/c/agent.json", "no json"), ("/two/SKILL.md", skill)]
    documents = nearest.described(spark.createDataFrame(texts, TEXTS))
    assert {r.path: (r.description, list(r.triggers)) for r in documents.collect()} == {
        "/a/b/README.md": ("Says what it is", []), "/a/b/skills/one/SKILL.md": ("from a skill", []), "/a/package.json": ("a package", ["k", "l"]), "/c/readme.md": ("nothing", []), "/two/SKILL.md": ("from a skill", [])}
    entities = spark.createDataFrame([
        ("one", "mcp", "/a/b/conf.json", None, None), ("two", "mcp", "/a/b/conf.json", " ", ["declared"]), ("three", "agent", "/a/x/conf.json", "", None), ("four", "mcp", "/c/conf.json", "its own", ["own"]),
        ("five", "mcp", "/d/e/f/conf.json", None, None), ("two", "mcp", "/conf.json", None, None), (None, "mcp", None, None, None)], "name string, type string, path string, description string, triggers array<string>")
    got = {(r.name, r.path): (r.description, r.found) for r in nearest.introspected(entities, documents).collect()}
    assert got == {
        ("one", "/a/b/conf.json"): ("from a skill", "/a/b/skills/one/SKILL.md"), ("two", "/a/b/conf.json"): ("Says what it is", "/a/b/README.md"), ("three", "/a/x/conf.json"): ("a package", "/a/package.json"),
        ("four", "/c/conf.json"): ("its own", "/c/readme.md"), ("five", "/d/e/f/conf.json"): ("mcp five", None), ("two", "/conf.json"): ("from a skill", "/two/SKILL.md"), (None, None): ("mcp", None)}
    triggers = {(r.name, r.path): list(r.triggers) for r in nearest.introspected(entities, documents).collect() if r.name}
    assert triggers["three", "/a/x/conf.json"] == ["k", "l", "three"] and triggers["four", "/c/conf.json"] == ["own", "four"] and triggers["two", "/a/b/conf.json"] == ["declared", "two"]


def test_triggers_keep_order_and_case(spark):
    rows = [("fooBar-baz", "Use when: the Foo, quite new. Rest", [" FOO ", "x", "", "Foo"]), ("a", None, None)]
    frame = spark.createDataFrame(rows, "n string, d string, t array<string>")
    got = [list(r[0]) for r in frame.select(T.synthesized_triggers(F.col("n"), F.col("d"), F.col("t"))).collect()]
    assert got[0][:5] == ["FOO", "x", "fooBar-baz", "bar", "baz"] and "quite new" in got[0] and len({t.lower() for t in got[0]}) == len(got[0]) and got[1] == ["a"]
