"""The catalog engine against stated expectations and against its SQL."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark import registry
from shelfmark.functions import text as T
from shelfmark.operators import catalog, chunks, graph, ledger, reports, retrieval
from shelfmark.plans import planner
from shelfmark.schema import Search
from shelfmark.sources import manifests

DATA = "/root/testdata/sf0.001"
ENTRY = "name string, description string, description_zh string, triggers array<string>, type string, visibility string, excluded boolean, agent_bound boolean, has_references boolean, full_text string"


def entries(spark, rows):
    """Rows of (name, description, triggers) or with visibility, agent_bound."""
    made = [(r[0], r[1], None, list(r[2]) if len(r) > 2 else [], "skill", v := (r[3] if len(r) > 3 else "ready"), v != "ready", r[4] if len(r) > 4 else None, False, r[1]) for r in rows]
    return spark.createDataFrame(made, ENTRY).withColumns({"id": F.concat_ws(":", "type", "name"), "ord": F.concat("type", F.lit(" "), F.lower("name"))})


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, query string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["search_topk", "search_ties", "overlap_candidates", "all_edges", "content_search", "token_economy", "markdown_chunks", "route_intents", "variants", "ledger_session", "dag_layers", "search_evidence", "name_refs", "merge_registry", "python_chunks", "file_outline", "graph_hubs", "similar_pairs"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_words_after_the_beginning_count(spark, tmp_path):
    text = "filler " * 100
    spark.createDataFrame([(i, text + w, "en", "s", 800) for i, w in enumerate(("quokka wombat", "quokka wombat", "other"), 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3, 6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x " * 60 + "quokka")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.name for r in at("search_topk")} == {"en0-3", "en0-4"}
    assert {r.id for r in at("pipeline_stages")} >= {"skill:en0-3", "skill:en0-4"}
    assert sorted(r.weight for r in at("overlap_edges_capped")) == [0.4, 0.4, 1.0]


def test_terms(spark):
    assert one(spark, T.terms, "a b c") == []
    assert set(one(spark, T.terms, "技能索引器 Code2")) == {"技能", "能索", "索引", "引器", "技能索", "能索引", "索引器", "code2"}


def test_triggers(spark):
    find = lambda text: one(spark, T.extracted_triggers, text)
    assert find("Advanced chart library. Use when user asks for G2 charts, bar charts, line charts, and pie charts.") == ["G2 charts", "bar charts", "line charts", "pie charts"]
    assert find("Visual tool. Use when users want to create data interpretations. 叙事文本可视化") == ["create data interpretations"]
    assert find("图表技能。触发词：柱状图、折线图、可视化") == ["柱状图", "折线图", "可视化"] and find("nothing here") == []


def test_pool(spark):
    rows = entries(spark, [("a", "", (), "ready", True), ("b", "", (), "off-list", True), ("c", "", (), "blocked", True), ("shelfmark", "", ()), ("d", "", (), "ready", None), ("e", "", (), "ready", False)])
    names = lambda **o: [r.name for r in retrieval.pool(rows, Search(**o)).orderBy("name").collect()]
    assert names() == ["a", "d", "e"] and names(include_off_list=True) == ["a", "b", "d", "e"]
    assert names(agent_only=True) == ["a", "d"] and names(include_excluded=True) == ["a", "b", "c", "d", "e"]


def test_search_prefers_rare_names_and_limits(spark):
    rows = entries(spark, [("约会议助手", "约会议 查闲忙 日程"), *[(f"pad-{i}", f"filler text number{i} meeting") for i in range(60)]])
    got = retrieval.search(ask(spark, "约会议查闲忙", "meeting"), rows, Search(top=100)).collect()
    assert [r.name for r in got if r.qid == 0] == ["约会议助手"]
    assert max(r.rank for r in got) <= 20 and all(r.score >= 0.35 for r in got)


def test_maximal(spark):
    df = spark.createDataFrame([("本地仓库里的配置", )], "q string").withColumn("t", T.terms(F.col("q")))
    row = df.select("t", T.maximal(F.col("t"), F.col("q")).alias("m")).first()
    assert 0 < len(row.m) <= len(row.t) / 2


def brute_cap(pairs, cap):
    used, out = {}, set()
    for u, v, w in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used.get(u, 0) < cap and used.get(v, 0) < cap:
            used[u], used[v] = used.get(u, 0) + 1, used.get(v, 0) + 1
            out.add((u, v))
    return out


@pytest.mark.parametrize("cap", [1, 3])
def test_greedy_cap(spark, cap):
    rng = random.Random(cap)
    pairs = sorted({(a, b) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.6})
    pairs = [(f"n{a:02}", f"n{b:02}", rng.choice([0.1, 0.2, 0.3])) for a, b in pairs]
    got = graph.capped(spark.createDataFrame(pairs, "u string, v string, weight double"), cap).collect()
    assert {(r.u, r.v) for r in got} == brute_cap(pairs, cap)


def test_used_up_rounds_are_told(spark):
    chain = [(f"n{i}", f"n{i + 1}", 0.5) for i in range(6)]
    pairs = spark.createDataFrame(chain, "u string, v string, weight double")
    with pytest.raises(RuntimeError):
        graph.capped(pairs, 1, most_rounds=2)
    assert {(r.u, r.v) for r in graph.capped(pairs, 1).collect()} == brute_cap(chain, 1)
    nodes, edges = spark.createDataFrame([(1, f"n{i}") for i in range(7)], "task int, id string"), pairs.select(F.col("u").alias("source"), F.col("v").alias("target"))
    with pytest.raises(RuntimeError):
        planner.layers(nodes, edges, most_rounds=2)
    assert [r.layer for r in planner.layers(nodes, edges).orderBy("id").collect()] == list(range(7, 0, -1))


def test_every_kind_of_edge(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(12)] for _ in range(3)]
    rows = entries(spark, [(f"n{i:02}", " ".join(base[i % 3][:8] + [f"x{rng.randrange(9)}y"])) for i in range(27)]).cache()
    got = registry._every_kind(rows).collect()
    for kind, cap in (("similar", 3), ("overlap", 6)):
        ends = [n for r in got if r.type == kind for n in (r.source, r.target)]
        assert ends and max(map(ends.count, ends)) == cap and all(r.weight >= 0.12 for r in got if r.type == kind)
    skills = {r.name: set(re.findall("[a-z0-9]{2,}", f"{r.name} txt {r.description}")) for r in rows.collect()}
    df = {t: sum(t in s for s in skills.values()) for s in skills.values() for t in s}
    idf = {t: max(0.1, 1 + (27 - n + 0.5) / (n + 0.5)) for t, n in df.items() if 2 <= n <= 40}
    total = lambda s: sum(idf.get(t, 0) for t in s)
    pairs = [(f"skill:{a}", f"skill:{b}", round(w, 3)) for a in skills for b in skills if a < b and len(skills[a] & skills[b] & idf.keys()) >= 3 and (w := total(skills[a] & skills[b]) / total(skills[a] | skills[b])) >= 0.12]
    assert {(r.source, r.target) for r in got if r.type == "similar"} == brute_cap(pairs, 3)


def test_name_references_need_word_bounds(spark):
    rows = entries(spark, [("code", "x"), ("a", "works on the codebase"), ("b", "uses code."), ("c.d", "y"), ("e", "calls c.d here")])
    assert {(r.source, r.target) for r in graph.name_references(rows).collect()} == {("skill:b", "skill:code"), ("skill:e", "skill:c.d")}


def test_layers(spark):
    nodes = spark.createDataFrame([(1, "app"), (1, "lib"), (2, "x"), (2, "y"), (2, "z")], "task int, id string")
    edges = spark.createDataFrame([("app", "lib"), ("x", "y"), ("y", "x"), ("z", "z")], "source string, target string")
    got = {(r.task, r.id): (r.layer, r.cyclic) for r in planner.layers(nodes, edges).collect()}
    assert got == {(1, "lib"): (1, False), (1, "app"): (2, False), (2, "z"): (1, False), (2, "x"): (2, True), (2, "y"): (2, True)}


def test_markdown_chunks(spark):
    lines = ["intro", "# One", *["a"] * 5, "```", "# masked", "```", "## Two", *["b"] * 6, "# Tiny", "c"]
    files = spark.createDataFrame([("s", "f.md", lines), ("s", "g.md", ["", " "]), ("s", "h.md", [])], "skill string, file string, lines array<string>")
    got = [(r.s, r.e, r.summary) for r in chunks.markdown_chunks(files).orderBy("s").collect()]
    assert got == [(1, 1, "intro"), (2, 10, "One"), (11, 19, "Two")]


def test_files_of_each_kind_and_feeding(spark, tmp_path):
    code, broken = ["def f(x):", *["    x += 1"] * 6, "", "class C:", *["    a = 1"] * 6], ["def broken("]
    rows = [("s", "a.md", ["# Usage", *["a"] * 6, "# Other", *["b"] * 6]), ("s", "b.PY", code), ("s", "c.py", broken), ("s", "d.txt", ["w"] * 60), ("big", "e.txt", ["w"] * 45 * 260)]
    cut = chunks.chunk_files(spark.createDataFrame(rows, "skill string, file string, lines array<string>")).cache()
    got = sorted((r.file, r.s, r.e, r.summary) for r in cut.filter("skill = 's'").collect())
    assert got == [("a.md", 1, 7, "Usage"), ("a.md", 8, 14, "Other"), ("b.PY", 1, 7, "f"), ("b.PY", 9, 15, "C"), ("c.py", 1, 1, "def broken("), ("d.txt", 1, 50, "w"), ("d.txt", 46, 60, "w")]
    big = [r.s for r in cut.filter("skill = 'big'").orderBy("s").collect()]
    assert big == [45 * i + 1 for i in range(200)]
    edges = spark.createDataFrame([("t", "s", "depends_on"), ("s", "u", "contains"), ("x", "s", "overlap")], "source string, target string, type string")
    fed = {(r.skill, r.file, r.s, r.fed_from) for r in chunks.cross_feed(edges, cut).collect()}
    assert fed == {("t", "a.md", 1, "s"), ("u", "a.md", 1, "s")}
    spark.createDataFrame([(1, "\n".join(code), "src"), (2, "plain words (\nmore", "src")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    own = registry.queries()["python_text_chunks"](spark, str(tmp_path)).collect()
    assert sorted((r.file, r.s, r.e, r.summary) for r in own) == [("1.py", 1, 7, "f"), ("1.py", 9, 15, "C"), ("2.py", 1, 2, "plain words (")]


def test_manifest_grammar():
    m = manifests.parse_manifest("﻿---\r\nname: \"x y\"\r\ndescription: |-\r\n  line one\r\n  line two\r\nnested:\r\n  a: b\r\ntriggers: [p, 'q']\r\n---\r\n# Title *bold*\r\n")
    assert (m["name"], m["description"], m["triggers"], m["h1"]) == ("x y", "line one\nline two", ["p", "q"], "Title bold") and "nested" not in m
    assert manifests.parse_manifest("# H\n\nfirst words")["description"] == "first words"


def test_ignore_rules(spark):
    rules = ("**/deep/", "/anchored/", "tmp/", "*.log", "!keep.log")
    paths = {"a/deep/x": True, "anchored/x": True, "b/anchored/x": False, "c/tmp/y": True, "z.log": True, "keep.log": False, "plain": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.i for r in df.select("p", manifests.ignored(F.col("p"), F.lit(False), rules).alias("i")).collect()} == paths


def test_scan_and_registry(spark, tmp_path):
    for path, text in (("a/SKILL.md", "---\nname: alpha\ndescription: does things\n---\n"), ("a/sub/skill.md", "nested"), ("b/c/Skill.md", "# Beta\n\nwords"), ("node_modules/z/skill.md", "no")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.name for r in manifests.scan_manifests(spark, [str(tmp_path)]).collect()}
    assert got == {"alpha", "Beta"}
    (tmp_path / "r.json").write_text('{"current_agent": "me", "skills": [{"name": "p", "status": "disabled", "agents": "x、me"}, "q", {"name": "P"}]}')
    rows = {r.name: r for r in manifests.read_registry(spark, str(tmp_path / "r.json")).collect()}
    assert rows["p"].visibility == "blocked" and rows["p"].agents == ["x", "me"] and set(rows) == {"p", "q"}
    bound = {r.name: r.agent_bound for r in catalog.bound_to(spark.createDataFrame([("p", ["x"]), ("q", None)], "name string, agents array<string>"), "me").collect()}
    assert bound == {"p": False, "q": True}


def test_reports(spark):
    rows = entries(spark, [(f"n{i}", "word " * 10) for i in range(10)])
    assert reports.token_economy(rows).first().inject_saving == pytest.approx(20.0)
    assert reports.token_economy(entries(spark, [("x", "y", (), "off-list")])).first().density is None
    assert ledger.compared(319100, 184000) == (135100, 42.3)
    gaps = spark.createDataFrame(registry.GAPS, "qid int, query string, evidence array<string>")
    assert [r[0] for r in gaps.orderBy("qid").select(T.uncovered_gap(F.col("query"), F.col("evidence"), F.size("evidence"))).collect()] == [True, False, False, False, False]


def test_streams_equal_batches(spark, tmp_path):
    from shelfmark.streaming import ledgers

    rows = [{"ts": f"2024-01-0{1 + i % 3}T00:00:0{i % 10}Z", "kind": ["search", "adopt", "chat"][i % 3], "query": "q", "n_hits": i % 2, "top": [], "agent": "a", "skill": f"s{i % 4}"} for i in range(40)]
    import json

    src = tmp_path / "events"
    src.mkdir()
    for k in range(4):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows[10 * k : 10 * k + 10])) + "\n{bad\n")
    stream = ledgers.promotions(ledgers.hit_stream(spark, str(src), 1), ("s1",))
    q = stream.writeStream.format("memory").queryName("promoted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.skill for r in ledger.promotions(manifests.read_hits(spark, str(src)), ["s1"]).collect()}
    assert {r.skill for r in spark.table("promoted").collect()} == batch


def test_python_segments(spark):
    code = ["", "# note", "import os", "A = 1", "def f(x):", *["    x += 1"] * 5, "B = [", "  1,", "]", "def g(): pass"]
    rows = [("s", "a.py", code), ("s", "b.py", ["x + 1", *["# c"] * 60]), ("s", "c.py", ["", " "]), ("s", "d.py", ["def broken("])]
    got = sorted((r.file, r.s, r.e, r.summary) for r in chunks.python_chunks(spark.createDataFrame(rows, "skill string, file string, lines array<string>")).collect())
    assert got == [("a.py", 1, 4, "# note"), ("a.py", 5, 14, "f"), ("b.py", 1, 61, "x + 1"), ("d.py", 1, 1, "def broken(")]


def brute_repair(edges, ids, pairs):
    edges = sorted(edges, key=lambda e: (e[0], e[2], e[1]))
    ends = lambda es: Counter(n for e in es for n in e[:2])
    limit = max(3 * sum(ends(edges).values()) / len(ends(edges)), 5)
    w = {e[:2]: e[3] for e in edges if e[2] == "depends_on"}
    lighter = {(p if w[p[::-1]] >= w[p] else p[::-1]) for p in w if p[0] < p[1] and p[::-1] in w}
    kept = [e for e in edges if not (e[2] == "depends_on" and e[:2] in lighter) and not (e[2] == "contains" and not set(e[:2]) <= ids)]
    pruned = 0
    for node, d in ends(kept).items():
        if d > limit:
            gone = sorted((e for e in kept if node in e[:2]), key=lambda e: e[3])[: d - int(limit)]
            kept = [e for e in kept if e not in gone]
            pruned += len(gone)
            if pruned > 50:
                break
    if ids - set(ends(edges)):
        linked = set(ends(kept))
        kept += [(u, v, "overlap", x) for u, v, x in pairs if u not in linked or v not in linked]
    return {(*e[:3], round(e[3], 6)) for e in kept}


@pytest.mark.parametrize("heavy", [12, 70])
def test_repair(spark, heavy):
    rng = random.Random(heavy)
    base = [f"w{i}" for i in range(60)]
    rows = entries(spark, [(f"n{i:03}", " ".join(rng.sample(base, 8))) for i in range(90)]).cache()
    ids = {f"skill:n{i:03}" for i in range(90)}
    some = sorted(ids)[:80]  # ten are isolated
    made = {(a, b, "depends_on"): round(rng.random(), 3) for a, b in (rng.sample(some, 2) for _ in range(30))}
    made |= {(b, a, "depends_on"): x if i % 2 else round(x / 2, 3) for i, ((a, b, _), x) in enumerate(sorted(made.items())[:6])}
    made |= {(hub, t, "overlap"): round(rng.random(), 2) for hub in some[3:9] for t in rng.sample(some, heavy) if t != hub}
    made |= {("skill:gone", some[0], "contains"): 0.7, (some[1], some[2], "contains"): 0.7}
    edges = [(*k, w) for k, w in made.items()]
    pairs = brute_cap([(r.u, r.v, round(r.jaccard, 3)) for r in graph.overlap_pairs(rows).filter("jaccard >= 0.05").collect()], 1)
    weight = {(r.u, r.v): round(r.jaccard, 3) for r in graph.overlap_pairs(rows).collect()}
    df = spark.createDataFrame([(a, b, k, "directed", w) for a, b, k, w in edges], "source string, target string, type string, direction string, weight double")
    got = {(r.source, r.target, r.type, round(r.weight, 6)) for r in graph.repaired(df, rows).collect()}
    assert got == brute_repair(edges, ids, [(u, v, weight[u, v]) for u, v in pairs])


def test_lifecycle(spark):
    names = ["requirement-planning", "docs-lookup", "feature-development", "code-development", "test-tdd", "debug", "review-code", "code-review", "salesforce-develop", "pad-x"]
    rows = entries(spark, [(n, f"{n.replace('-', ' ')} words") for n in names] + [("slop", "x", (), "off-list")])
    tasks = spark.createDataFrame([(1, "develop a feature module"), (2, "write a letter"), (3, "develop the salesforce app")], "qid int, query string")
    out = planner.lifecycle(tasks, rows, {"审查把关": "code-review"}).collect()
    assert {r.task for r in out} == {1, 3}
    for task in (1, 3):
        mine = [r for r in out if r.task == task]
        assert {r.stage for r in mine} == set(range(1, 11)) and max(Counter(r.name for r in mine if r.name).values()) == 1
        at = {t: [(r.name, r.basis) for r in mine if r.title == t] for t in {r.title for r in mine}}
        assert at["审查把关"] == [("code-review", "preference")] and at["清理瘦身"] == [(None, "general")]
        assert ("salesforce-develop", "seed") in at["编码实现"] and "pad-x" not in {r.name for r in mine}
    served, planned = planner.pipeline(tasks, rows, spark.createDataFrame([], "source string, target string, type string"))
    assert {r.task for r in served.collect()} == {1, 3} and not {r.task for r in planned.collect()} & {1, 3}
    assert planner.lifecycle(tasks, entries(spark, [("zebra", "nothing")])).count() == 0


def test_collaborators_and_report(spark):
    rows = entries(spark, [("lone", "alpha beta 77"), ("near", "alpha beta gamma"), ("far", "delta 77"), ("hidden", "alpha beta", (), "off-list"), ("near-twin", "alpha words")])
    edges = spark.createDataFrame([("skill:near", "skill:far", "family", 0.5)], "source string, target string, type string, weight double")
    got = {(r.node, r.other): (r["rank"], r.weight) for r in retrieval.collaborators(rows, edges).filter("node = 'skill:lone'").collect()}
    assert got == {("skill:lone", "skill:near"): (1, 0.95), ("skill:lone", "skill:near-twin"): (2, 0.79)}  # one of seven terms
    told = retrieval.report(ask(spark, "alpha beta", "合同"), rows, edges).collect()
    near = next(r for r in told if r.name == "near")
    assert near.twins == ["near-twin"] and near.neighbours == ["far"] and [r.qid for r in told if r.name is None] == [1] and not any(r.gap for r in told)


def test_lists_and_staleness(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in ("- `a`: one | two", "2. b | two", "# no", " ", "c — d: e", "plain", "x - y")], "value string")
    assert [(r.name, r.description) for r in manifests.read_list(lines).collect()] == [("a", "one | two"), ("b", "two"), ("c — d", "e"), ("plain", ""), ("x", "y")]
    (tmp_path / "l.json").write_text('{"items": [{"title": "p", "desc": "d", "trigger": "u、v"}, "q: r", {"x": 1}], "more": 1}')
    assert sorted((r.name, r.description, r.triggers) for r in manifests.read_items(spark, str(tmp_path / "l.json")).collect()) == [("p", "d", ["u", "v"]), ("q", "r", [])]
    rows = spark.createDataFrame([("skill", f"/p{i}") for i in range(4)], "type string, path string")
    told = manifests.stale_share(rows, spark.createDataFrame([("/p1",)], "path string")).first()
    assert (told.share, told.stale) == (0.75, False) and manifests.stale_share(rows.limit(2), rows).first().share is None


def test_exports(spark, tmp_path):
    from shelfmark.sources import exports

    rows = entries(spark, [("a", "one | two\nthree", ("t", "u")), ("b", "x")]).withColumns({"path": F.lit("/p"), "source": F.lit("s")})
    edges = spark.createDataFrame([("skill:a", "skill:b", "family", "undirected", 1.0), ("skill:a", "skill:z", "family", "undirected", 1.0)], "source string, target string, type string, direction string, weight double")
    read = lambda form: sorted(r.value for r in spark.read.text(f"{tmp_path}/{form}").collect())
    for form in ("json", "md", "txt", "csv"):
        exports.write(rows, form, f"{tmp_path}/{form}")
    assert read("json")[1] == '{"n":"b","d":"x","g":[],"t":"skill","r":false,"s":"s"}' and read("md")[0] == "| a | skill | one \\| two three | t、u |"
    assert read("txt") == ["a[s]: one | two three | 触发: t、u", "b[s]: x"] and spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/csv").count() == 2
    nodes, links = exports.dashboard(rows, edges)
    assert nodes.count() == 2 and links.count() == 1
    exports.write_index(rows, edges, f"{tmp_path}/index")
    exports.write_bundle(rows, edges, f"{tmp_path}/bundle")
    assert spark.read.parquet(f"{tmp_path}/index/edges").count() == 2 and spark.read.text(f"{tmp_path}/bundle/L0").count() == 2
    lines = [r.value for r in exports.catalog_markdown(rows).orderBy("type", "ord").collect()]
    assert lines[0] == "## SKILL（2）" and lines[1] == "- **a**: one | two\nthree\n  - 触发: t、u\n  - 位置: `/p`"


def test_sql_functions(spark):
    from shelfmark.functions import sql

    sql.register(spark)
    text = "技能索引器 Code2 a bb"
    assert set(spark.sql(f"SELECT shelfmark_terms('{text}')").first()[0]) == set(one(spark, T.terms, text))
    assert spark.sql("SELECT shelfmark_tokens(10), shelfmark_weight('ab字'), shelfmark_identifier_parts('aB-cd')").first()[:] == (2, 4, ["aB-cd", "cd"])


def brute_fingerprint(rows):
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
    groups = {}
    for name, description in rows:
        h = digest(f"{name}\t{description or ''}")
        groups.setdefault(h[:3], []).append(h)
    return digest("".join(digest("".join(sorted(groups[p]))) for p in sorted(groups)))[:12]


def test_fingerprint(spark):
    rows = [(f"n{i}", None if i % 7 == 0 else f"text {i % 5}") for i in range(300)]
    mark = lambda some: catalog.fingerprint(spark.createDataFrame(some, "name string, description string")).first()[0]
    assert mark(rows) == mark(rows[::-1]) == brute_fingerprint(rows)
    assert mark([("n0", "new"), *rows[1:]]) != mark(rows) != mark(rows[1:]) and mark([]) == brute_fingerprint([])


def brute_plan(seeds, edges, most=9, each=3):
    """(mode, {(stage, id, seed, cyclic)}) of one task by plain loops."""
    chosen = list(seeds)
    for a, b in sorted(set(edges)):
        if len(chosen) < most and a in chosen and b not in chosen:
            chosen.append(b)
    inner = {(a, b) for a, b in edges if a != b and a in chosen and b in chosen}
    tied = {x for e in inner for x in e}
    layer, at = {}, 1
    while ready := {x for x in tied - layer.keys() if all(b in layer for a, b in inner if a == x)}:
        layer |= dict.fromkeys(ready, at)
        at += 1
    cyclic = tied - layer.keys()
    layer |= dict.fromkeys(cyclic, at)
    out = set()
    for n in set(layer.values()):
        out |= {(n, x, x in seeds, x in cyclic) for x in sorted((x for x in layer if layer[x] == n), key=lambda x: (x not in seeds, x))[:each]}
    last = max(layer.values(), default=0) + 1
    return ("topological" if tied else "parallel"), out | {(last, x, x in seeds, False) for x in chosen if x not in tied}


def test_plans_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["quokka", "wombat", "numbat", "bilby", "dunnart"]
    rows = entries(spark, [(f"item{i}", " ".join(rng.sample(words, 2)) + f" only{i}") for i in range(30)])
    tasks = ask(spark, "quokka", "wombat bilby", "only3 only4", "nothing there", "only29", "only1 only2")
    edges = [(f"skill:item{a}", f"skill:item{b}") for a, b in [(rng.randrange(29), rng.randrange(29)) for _ in range(45)]] + [("skill:item1", "skill:item2"), ("skill:item2", "skill:item1"), ("skill:item3", "skill:item3")]
    table = spark.createDataFrame([(a, b, "depends_on") for a, b in edges] + [("skill:item29", "skill:item5", "family")], "source string, target string, type string")
    seeds = {}
    for r in sorted(retrieval.search(tasks, rows, Search(top=6)).collect(), key=lambda r: r["rank"]):
        seeds.setdefault(r.qid, []).append(r.id)
    got = {}
    for r in planner.plan(tasks, rows, table).collect():
        got.setdefault(r.task, (r.mode, set()))[1].add((r.stage, r.id, r.seed, r.cyclic))
    assert got == {q: brute_plan(s, edges) for q, s in seeds.items()} and {m for m, _ in got.values()} == {"topological", "parallel"}
    assert any(x[3] for _, some in got.values() for x in some) and 3 not in got


def test_gate_log_and_retry(spark):
    from shelfmark.streaming.ledgers import gate

    assert [gate("b", "a", 0, 0), gate("a", None, 999, 9, force=True), gate("a", "a", 301, 1), gate("a", "a", 301, 0), gate("a", "a", 300, 5, force=True), gate("a", "a", 10, 5)] == [
        (True, "changed"), (False, "first"), (True, "due"), (False, "fresh"), (True, "forced"), (False, "fresh")]
    log = lambda lines, most: [r.n for r in ledger.last_entries(spark.createDataFrame(list(enumerate(lines, 1)), "n int, line string"), most).orderBy("n").collect()]
    entry = ["## day", "- why", "  what", ""]
    assert log(entry * 4, 16) == list(range(1, 17)) and log(entry * 4, 10) == list(range(9, 17)) and log(["x"] * 9, 4) == [6, 7, 8, 9] and log(["y", *entry], 9) == [1, 2, 3, 4, 5] and log([], 4) == []
    old, asked = entries(spark, [("one", "alpha words"), ("two", "beta words")]), []
    both = old.unionByName(entries(spark, [("three", "gamma words")]))
    found = lambda q, newer: {(r.qid, r.name) for r in retrieval.search_or_refresh(q, old, lambda missed: asked.append({r.qid for r in missed.collect()}) or newer).collect()}
    assert found(ask(spark, "alpha", "gamma"), both) == {(0, "one"), (1, "three")} and asked == [{1}]
    assert found(ask(spark, "alpha", "gamma"), None) == {(0, "one")} and found(ask(spark, "beta"), both) == {(0, "two")} and asked == [{1}, {1}]


def test_heartbeat_goes_on_after_a_restart(spark, tmp_path):
    from shelfmark.streaming import ledgers

    src, marks, calls = tmp_path / "src", ["a"], []
    src.mkdir()
    for n in range(4):
        (src / f"{n}.json").write_text("".join(f'{{"ts": "2024-01-0{n + 1}T00:00:0{i}", "kind": "search", "query": "q{n}{i}", "n_hits": 1}}\n' for i in range(3)))
        marks[0] = "b" if n >= 2 else "a"
        q = ledgers.refresh_on_change(ledgers.hit_stream(spark, str(src)), lambda s: marks[0], lambda batch, number: calls.append(number), str(tmp_path / "cp"), "0 seconds", keep=5, forced=lambda: n == 3)
        q.processAllAvailable()
        q.stop()
    assert calls == [2, 3]  # another fingerprint, then on demand; the first beat only sets one
    state = spark.read.parquet(f"{tmp_path}/cp-gate")
    assert {(r.beat, r.fingerprint, r.reason, r.interactions) for r in state.collect()} == {(2, "b", "changed", 0), (3, "b", "forced", 0)}
    assert {r.query for r in spark.read.parquet(f"{tmp_path}/cp-recent").filter("beat = 3").collect()} == {"q30", "q31", "q32", "q22", "q21"}
