"""Edges of all kinds are written once, and hot terms leave by broadcast without a change of results."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark import registry
from shelfmark.operators import graph


def test_edges_of_all_kinds_are_made_once(spark):
    _, edges = registry._all_kinds(spark, "/root/testdata/sf0.001")
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [3, 1_000])
def test_hot_terms_change_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(2)
    words = {f"skill:s{i}": sorted({f"w{min(int(rng.paretovariate(0.5)), 200)}" for _ in range(30)}) for i in range(60)}
    rows = spark.createDataFrame([(k, k[6:], "skill", " ".join(w), None, [], k) for k, w in words.items()], "id string, name string, type string, description string, description_zh string, triggers array<string>, ord string")
    sets = {k: {*w, k[6:]} for k, w in words.items()}
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    want = {}
    for u in sets:
        for v in sets:
            shared = sets[u] & sets[v]
            middling = sum(2 <= df[t] <= 20 for t in shared)
            if u < v and middling >= 2:
                want[u, v] = (middling, round(middling / len(sets[u] | sets[v]), 9))
    got = {(r.u, r.v): (r.shared, round(r.jaccard, 9)) for r in graph.overlap_pairs(rows, (2, 20)).collect()}
    assert got == want and want
    told = graph.similar_pairs(rows.select(F.col("name").alias("skill"), F.explode(F.split("description", " ")).alias("term")), df_range=(2, 20), budget=None)
    assert {(r.u, r.v): r.shared for r in told.collect()} == {(u[6:], v[6:]): n for (u, v), (n, _) in want.items() if n >= 3}
