"""Whole jobs: what caps on work once left out."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import alike, graph
from shelfmark.shared import tabled
from test_shuffled import shuffled


@pytest.fixture(scope="module")
def crowded(spark):
    """skill, term: ten groups of 39 skills make more than a million pairs by terms rarer than those that 40 others share."""
    rows = spark.range(10 * 39 * 140).selectExpr("concat('g', id % 390) as skill", "concat('t', id % 10, 'x', id div 390) as term")
    return tabled(rows.unionByName(spark.range(40 * 4).selectExpr("concat('late', id % 40) as skill", "concat('shared', id div 40) as term")))


def test_similar_edges_of_terms_beyond_a_million_pairs(spark, crowded):
    assert graph.similar_dropped(crowded, (2, 40), 1_000_000).first().dropped >= 4
    names = crowded.select(F.col("skill").alias("name")).distinct()
    e = names.selectExpr("concat('skill:', name) as id", "name", "'skill' as type", "name as ord")
    got = graph.similar_edges(crowded, e).collect()
    late = [n for r in got if r.u.startswith("skill:late") for n in (r.u, r.v)]
    assert len(set(late)) == 40 and max(map(late.count, late)) == 3 and all(r.weight == 1 for r in got)


def test_similar_pairs_of_terms_beyond_a_million_pairs(spark, crowded):
    got = graph.similar_pairs(crowded).groupBy(F.substring("u", 1, 4).alias("kind"), "shared").agg(F.count("*").alias("n"), F.min("weight").alias("w"))
    assert {tuple(r) for r in got.filter("kind = 'late'").collect()} == {("late", 4, 780, 1.0)} and got.agg(F.sum("n")).first()[0] == 780 + 10 * 741


def test_repair_prunes_every_hub(spark):
    """Hubs joined with each other, far more than 50 edges too many; brute force takes them one by one."""
    rng = random.Random(6)
    hubs, rest = [f"skill:h{i:02}" for i in range(30)], [f"skill:n{i:04}" for i in range(900)]
    made = {(*sorted((h, x)), "overlap"): rng.randrange(9) / 10 for h in hubs for x in rng.sample(rest, 25) + rng.sample(hubs, 14) if x != h}
    kept = sorted(((a, b, k, w) for (a, b, k), w in made.items()), key=lambda e: (e[0], e[2], e[1]))
    degree = Counter(n for e in kept for n in e[:2])
    limit, pruned = max(3 * sum(degree.values()) / len(degree), 5), 0
    for node, d in degree.items():
        if d > limit:
            gone = set(sorted((e for e in kept if node in e[:2]), key=lambda e: e[3])[: d - int(limit)])
            kept, pruned = [e for e in kept if e not in gone], pruned + len(gone)
    e = spark.createDataFrame([(n, n[6:], "skill", n, "", None, []) for n in hubs + rest if n in degree], "id string, name string, type string, ord string, description string, description_zh string, triggers array<string>")
    edges = spark.createDataFrame([(*k, "undirected", w) for k, w in made.items()], "source string, target string, type string, direction string, weight double")
    got = {(r.source, r.target, r.type, r.weight) for r in graph.repaired(edges, e, prunes=None).collect()}
    assert pruned > 500 and got == set(kept)


def test_most_alike_sends_no_more_for_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(alike, "BLOCK", 32)
    rng = random.Random(7)
    words = [f"w{i:03}" for i in range(300)]
    rows = [(f"i{i:04}", f"o{i:04}", f"n{i:04}", False, rng.sample(words, 60)) for i in range(1500)]
    sets = tabled(spark.createDataFrame(rows, "id string, ord string, low string, out boolean, terms array<string>"))
    found, given = [], sets.filter("id < 'i0512'").select("id")
    moved = shuffled(spark, lambda: found.extend(alike.most_alike(sets, given, 3).collect()))
    assert len(found) == 3 * 512 and moved < 20 * 1500 * 60


def test_most_alike_over_pieces_of_a_task(monkeypatch):
    monkeypatch.setattr(alike, "BLOCK", 4)
    rng = random.Random(8)
    rows = [{"id": f"i{i}", "ord": f"o{i % 7}", "low": f"n{i}", "size": 5, "terms": rng.sample(range(12), 4), "digits": [20 + i % 2]} for i in range(30)]
    typed = pa.schema([("id", pa.string()), ("ord", pa.string()), ("low", pa.string()), ("size", pa.int64()), ("terms", pa.list_(pa.int64())), ("digits", pa.list_(pa.int64()))])
    table = pa.Table.from_pylist(rows, typed)

    class Sent:
        value = alike._bytes(table)

    got = {(r["node"], r["id"], round(r["share"], 9)) for b in alike._best(Sent, 3)(iter(table.to_batches(max_chunksize=3))) for r in b.to_pylist()}
    share = lambda a, b: len(s := set(a["terms"]) & set(b["terms"])) / (10 - len(s) - len(set(a["digits"]) & set(b["digits"])))
    want = set()
    for a in rows:
        first = sorted((-share(a, b), b["ord"], b["id"]) for b in rows if b is not a and share(a, b))[:3]
        want |= {(a["id"], i, round(-s, 9)) for s, _, i in first}
    assert got == want
