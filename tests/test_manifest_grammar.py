"""Front matter as files have it, and the SQL functions that came with it."""

import pytest

from shelfmark.functions import manifest
from shelfmark.functions import text as T


def fm(*lines, body=""):
    return "---\n" + "\n".join(lines) + "\n---\n" + body


@pytest.mark.parametrize("lines,value", [
    ((">", "  one", "  two", "", "  three", "", "", "  four"), "one two\nthree\n\nfour"),
    ((">-", "    one", "      two", "    three"), "one two three"),
    (("|", "    one", "      two", "", "    three"), "one\n  two\n\nthree"),
    (("|+2", "  one", "", ""), "one"),
    (("plain", "  goes on", "  and on"), "plain goes on and on"),
    (("plain", "  key: is left out", "  goes on"), "plain goes on"),
    (('"quoted: text"',), "quoted: text"),
    (("'single'", "  and more"), "single and more"),
    (("", "  on the", "  next lines"), "on the next lines"),
    (("", "  >", "  folded", "  below"), "folded below"),
    (("", "  |", "  as", "    it is"), "as\n  it is"),
    (("", "  a: map", "  b: of two"), None),
    (("", "  - one", "  - 'two'"), ["one", "two"]),
    (("[a, \"b\", 'c d']",), ["a", "b", "c d"]),
    (("",), None)])
def test_values(lines, value):
    found, body = manifest.front_matter(fm("name: n", f"description: {lines[0]}".rstrip(), *lines[1:], "after: x", body="text"))
    assert found.get("description") == value and found["after"] == "x" and body == ["text"]


def test_names_titles_and_paragraphs():
    assert manifest.parse("---\nname: x\nno end") | {} == {"h1": "", "name": "", "description": "---\nname: x\nno end"}
    got = manifest.parse("﻿---\r\nName: 'It'\r\n---\r\n\r\n## deeper\r\n```\r\n# The *very* `title` of  it all\r\n\r\nfirst line\r\nsecond line\r\n\r\nnext")
    assert got == {"name": "It", "h1": "The very title of it all", "description": "first line\nsecond line"}
    got = manifest.parse("words before\n\n#  Late Heading\n\n" + "p" * 400)
    assert got["name"] == "Late Heading" and got["h1"] == "" and got["description"] == "words before"
    assert manifest.parse("# T\n\n" + "p" * 400)["description"] == "p" * 300 and manifest.parse("# " + "t" * 50)["h1"] == "t" * 40
    assert manifest.parse("") == {"h1": "", "name": "", "description": ""}


def test_sql_functions(spark):
    from shelfmark.functions import sql

    sql.register(spark)
    rows = [("a", fm("name: n", "description: >", "  one", "  two", "triggers: x、y")), ("b", None)]
    spark.createDataFrame(rows, "id string, t string").createOrReplaceTempView("shelfmark_test_manifests")
    got = {r.id: r.m for r in spark.sql("SELECT id, shelfmark_front_matter(t) AS m FROM shelfmark_test_manifests").collect()}
    assert got["a"].asDict() == {"name": "n", "description": "one two", "description_zh": None, "listed": ["x", "y"], "h1": ""} and got["b"].name == ""
    entry = spark.createDataFrame([("n", "skill", True, "a  b\n" + "c" * 500, ["t", "", "u"])], "name string, type string, has_references boolean, description string, triggers array<string>")
    entry.createOrReplaceTempView("shelfmark_test_entries")
    both = spark.sql("SELECT shelfmark_dense_line(name, type, has_references, description, triggers) AS l FROM shelfmark_test_entries").first().l
    assert both == entry.select(T.dense_line().alias("l")).first().l and both.startswith("n[sR]: a b c")
    for query in ("重算公式 excel", "code code2 ode", "算公"):
        frame = spark.createDataFrame([(query,)], "q string").select("q", T.terms(spark_col("q")).alias("t"))
        frame.createOrReplaceTempView("shelfmark_test_query")
        assert spark.sql("SELECT shelfmark_maximal(t, q) AS m FROM shelfmark_test_query").first().m == frame.select(T.maximal(spark_col("t"), spark_col("q")).alias("m")).first().m


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
