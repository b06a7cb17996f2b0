"""What steps write, so that later joins know its size, and joins of rounds that send nothing through the driver."""

from pyspark.sql import functions as F

from shelfmark.operators import retrieval
from shelfmark.plans import planner


def test_shortlist_is_written(spark):
    pairs = spark.range(200).select((F.col("id") % 3).alias("qid"), F.col("id").alias("k"), (F.col("id") / 10).alias("bound"))
    score = {k: k / 10 - (k % 7) / 10 for k in range(200)}
    exact = lambda some: some.withColumn("score", F.col("k") / 10 - F.col("k") % 7 / 10)
    found = retrieval.shortlist(pairs, exact, 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.qid, r.k) for r in found.collect()}
    best = {(q, k) for q in range(3) for k in sorted((k for k in score if k % 3 == q), key=lambda k: -score[k])[:2]}
    assert best <= got and len(got) < 30


def test_layers_broadcast_nothing(spark, monkeypatch):
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tabled(df)

    tabled = planner.tabled
    monkeypatch.setattr(planner, "tabled", watched)
    nodes = spark.range(40).select(F.lit(1).alias("task"), F.col("id").cast("string").alias("id"))
    edges = spark.range(1, 40).select(F.col("id").cast("string").alias("source"), F.expr("cast(id div 3 as string)").alias("target"))
    got = {int(r.id): r.layer for r in planner.layers(nodes, edges).collect()}
    assert (got[0], got[2], got[3], got[39]) == (1, 2, 3, 5)
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_collaborators_of_some_nodes_alone(spark):
    rows = spark.createDataFrame([(f"skill:n{i}", f"n{i}", f"n{i}", "alpha beta", None, [], False) for i in range(4)], "id string, name string, ord string, description string, description_zh string, triggers array<string>, excluded boolean")
    edges, only = spark.createDataFrame([], "source string, target string"), spark.createDataFrame([("skill:n1",)], "id string")
    assert [r.node for r in retrieval.collaborators(rows, edges, only=only).collect()] == ["skill:n1"] * 3
    touched = spark.createDataFrame([("skill:n1", "skill:n2")], "source string, target string")
    assert retrieval.collaborators(rows, touched, only=only).collect() == []
