"""What is kept between runs: generations of tables, the content index, and the reconciled catalog."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, chunks, content
from shelfmark.shared import tabled
from shelfmark.sources.store import POINTERS, Store, Superseded

FILES = "skill string, file string, mtime bigint, lines array<string>"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_readers_see_whole_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.current().number == 0 and store.read(store.current(), "a") is None
    one = store.commit(store.current(), {"a": spark.range(3), "b": spark.range(1)}, {"x": 1})
    reader = store.current()
    two = store.commit(one, {"a": spark.range(5), "b": one.tables["b"]})
    assert (one.number, two.number, store.current()) == (1, 2, two)
    assert (store.read(reader, "a").count(), store.read(two, "a").count(), store.read(two, "b").count()) == (3, 5, 1) and reader.facts == {"x": 1}
    # one of two writers that go on from the same generation is told
    with pytest.raises(Superseded):
        Store(spark, store.root).commit(one, {"a": spark.range(9)})
    assert store.current() == two


def test_a_killed_writer_and_another_format(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = store.commit(store.current(), {"a": spark.range(3)})
    store.written(spark.range(7))  # killed before its pointer
    (tmp_path / "s" / POINTERS / "2.json").write_text('{"format": 1, "tab')  # killed while it wrote it
    assert store.current() == one
    three = store.commit(one, {"a": spark.range(4)})
    assert three.number == 3 and store.read(store.current(), "a").count() == 4
    newer = Store(spark, store.root, format=2)
    assert newer.current() is None  # to be built anew
    built = newer.commit(None, {"a": spark.range(1)})
    assert newer.current() == built and store.current() is None
    assert len(newer.sweep(keep=1)) == 3 and newer.read(built, "a").count() == 1


def made(rng, n):
    words = [f"word{i}" for i in range(40)]
    return [" ".join(rng.choices(words, k=6)) for _ in range(n)]


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Five rounds of files that come, change and go, with a limit on a skill's chunks, and segments merged on the way."""
    rng, store, files, read = random.Random(2), Store(spark, str(tmp_path / "s")), {}, []

    def chunked(some):
        read.append({(r.skill, r.file) for r in some.select("skill", "file").collect()})
        return chunks.plain_chunks(some, 4, 1)

    queries = spark.createDataFrame([("a", "word1 word2 f3"), ("b", "word39"), ("c", "nothing here")], "qid string, query string")
    for round_ in range(5):
        before = dict(files)
        for key in rng.sample(sorted(files), len(files) // 4):
            if rng.random() < 0.5:
                del files[key]
            else:
                files[key] = (files[key][0] + 1, made(rng, rng.randrange(0, 9)))
        for _ in range(6):
            files[rng.choice("xyz"), f"f{rng.randrange(40)}.txt"] = (round_ * 10 + 100, made(rng, rng.randrange(1, 12)))
        now = spark.createDataFrame([(*k, *v) for k, v in files.items()], FILES)
        index, counts = content.update(store, now, chunked, most=8, most_segments=2)
        changed = {k for k, v in files.items() if before.get(k) != v}
        assert read[-1] == changed  # no other file is chunked or tokenised
        told = dict(rows_of(counts))
        assert told.get("added", 0) == len(set(files) - set(before)) and told.get("removed", 0) == len(set(before) - set(files))
        assert told.get("kept", 0) == len(files) - len(changed)
        every = chunks.plain_chunks(now, 4, 1)
        shown = every.withColumn("r", F.expr("row_number() over (partition by skill order by file, s, e)")).filter("r <= 8").drop("r")
        assert rows_of(content.frequencies(store, index)) == rows_of(chunks.chunk_postings(shown).groupBy("term").count())
        assert index.facts["shown"] == shown.count() and index.facts["segments"] <= 2
        assert rows_of(content.living(store, index, "chunks").select("skill", "file", "s", "e", "summary")) == rows_of(shown.drop("text"))
        assert rows_of(content.search(store, index, queries)) == rows_of(chunks.content_search(queries, shown))
    same, counts = content.update(store, now, chunked, most=8)
    assert same == store.current() == index and rows_of(counts) == [("kept", len(files))]


def test_an_empty_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], FILES)
    index, counts = content.update(store, none, chunks.plain_chunks)
    assert counts.count() == 0 and content.search(store, index, spark.createDataFrame([("q", "word1")], "qid string, query string")).count() == 0


LISTED = "name string, description string, triggers array<string>, visibility string, ord string, description_zh string"
DISK = "name string, description string, triggers array<string>, path string, mtime bigint, ord string"


def listed(spark, *rows):
    return spark.createDataFrame([(n, d, [], v, f"skill {n}", zh) for n, d, v, zh in rows], LISTED)


def disk(spark, *rows):
    return spark.createDataFrame([(n, d, [], f"/d/{n}", t, f"skill {n}") for n, d, t in rows], DISK)


def changes(index):
    return {(r.name, r.origin): (r.change, r.visibility, r.variant_of) for r in index.collect()}


def test_reconcile_promotes_keeps_and_falls_back(spark):
    text = "support customers with tickets and refunds"
    base, blocked = ("crm-support", text, "ready", None), ("old-one", "gone soon", "blocked", None)
    found = [("crm-support-snake", "tickets and refunds of customers", 5), ("crm-support-zoo", "animals", 5), ("alone", "by itself", 5), ("Crm-Support", "the listed one on disk", 5)]
    first = tabled(catalog.reconcile(listed(spark, base, blocked), disk(spark, *found)))
    assert changes(first) == {
        ("crm-support", "list"): ("added", "ready", None), ("old-one", "list"): ("added", "blocked", None),
        ("crm-support-snake", "disk"): ("added", "ready", "crm-support"), ("crm-support-zoo", "disk"): ("added", "off-list", None), ("alone", "disk"): ("added", "off-list", None)}
    # nothing has changed: nothing is added, updated or removed, and a promoted variant is no news
    again = tabled(catalog.reconcile(listed(spark, base, blocked), disk(spark, *found), first))
    assert {c for c, _, _ in changes(again).values()} == {"kept"}
    # a translation is a change; a touched file is one; a name that leaves the disk or the list is removed
    third = tabled(catalog.reconcile(listed(spark, (*base[:3], "支持")), disk(spark, found[0], ("alone", "by itself", 6)), again))
    assert changes(third) == {
        ("crm-support", "list"): ("updated", "ready", None), ("old-one", "list"): ("removed", "blocked", None), ("crm-support-snake", "disk"): ("kept", "ready", "crm-support"),
        ("crm-support-zoo", "disk"): ("removed", "off-list", None), ("alone", "disk"): ("updated", "off-list", None)}
    # without its base a variant falls back; an entry of the disk that the list takes in leaves the disk's part
    fourth = tabled(catalog.reconcile(listed(spark, ("alone", "by itself", "ready", None)), disk(spark, found[0], ("alone", "by itself", 6)), third))
    assert changes(fourth) == {
        ("crm-support", "list"): ("removed", "ready", None), ("alone", "list"): ("added", "ready", None), ("alone", "disk"): ("removed", "off-list", None),
        ("crm-support-snake", "disk"): ("updated", "off-list", None)}
    # and it is promoted again when the base comes back, which is an update of what was off-list
    fifth = catalog.reconcile(listed(spark, base), disk(spark, found[0]), fourth)
    assert changes(fifth)["crm-support-snake", "disk"] == ("updated", "ready", "crm-support")


def test_reconcile_reuses_what_was_read(spark):
    """A file of the same time keeps what the last index has of it, whatever a new reading says."""
    first = tabled(catalog.reconcile(listed(spark), disk(spark, ("one", "as first read", 1))))
    second = catalog.reconcile(listed(spark), disk(spark, ("one", "read anew", 1)), first).collect()
    assert [(r.description, r.change) for r in second] == [("as first read", "kept")]
    third = catalog.reconcile(listed(spark), disk(spark, ("one", "read anew", 2)), first).collect()
    assert [(r.description, r.change) for r in third] == [("read anew", "updated")]


def test_cross_feed_within_two_budgets(spark):
    """The main file first, then so many others by name; what one dependency leaves over goes on to the next; connectors by description."""
    made = lambda skill, file, n: [(skill, file, i, i, f"{skill} {i}", "usage of it") for i in range(1, n + 1)]
    rows = [*made("b", "b.md", 2), *made("b", "SKILL.md", 3), *made("b", "a.md", 1), *made("b", "c.md", 4), *made("c", "skill.md", 9), ("c", "x.md", 1, 1, "", "nothing to tell")]
    part = spark.createDataFrame(rows, "skill string, file string, s int, e int, summary string, text string")
    edges = spark.createDataFrame([("a", "b", "depends_on"), ("a", "c", "depends_on"), ("d", "c", "contains"), ("a", "m", "depends_on"), ("a", "gone", "family")], "source string, target string, type string")
    entries = spark.createDataFrame([("m", "mcp", "what it does"), ("c", "mcp", "has files")], "name string, type string, description string")
    got = [(r.skill, r.fed_from, r.file, r.s) for r in chunks.cross_feed(edges, part, most=8, files=2, entries=entries).collect()]
    want = [("b", "SKILL.md", i) for i in (1, 2, 3)] + [("b", "a.md", 1), ("b", "b.md", 1), ("b", "b.md", 2)] + [("c", "skill.md", 1), ("c", "skill.md", 2)]
    assert sorted(g[1:] for g in got if g[0] == "a") == sorted(want)
    assert sorted(g[1:] for g in got if g[0] == "d") == [("c", "skill.md", i) for i in range(1, 9)]
    few = [r.file for r in chunks.cross_feed(edges.filter("target = 'm'"), part, entries=entries).collect()]
    assert few == ["MCP@m"]


def test_a_ledger_is_rotated_when_it_is_large(spark, tmp_path):
    from shelfmark.operators import ledger
    from shelfmark.sources.manifests import read_hits

    rows = spark.range(90).selectExpr("timestamp_seconds(id * 4000) as ts", "'chat' as kind", "concat('s', id) as skill", "1 as n_hits")
    rows.write.json(str(tmp_path / "hits"))
    assert not ledger.rotated(spark, str(tmp_path / "hits"), str(tmp_path / "none"))
    assert ledger.rotated(spark, str(tmp_path / "hits"), str(tmp_path / "newest"), most=1_000)
    assert {r.skill for r in read_hits(spark, str(tmp_path / "newest")).collect()} == {f"s{i}" for i in range(31, 90)}
