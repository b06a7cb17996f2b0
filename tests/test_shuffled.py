"""What is shuffled: texts are moved to where they are needed and no more often."""

import random
import time

from pyspark.sql import functions as F

from shelfmark.operators import catalog
from shelfmark.shared import tabled


def shuffled(spark, job) -> float:
    """Bytes of shuffles that a job writes."""
    def total():
        time.sleep(1.5)  # the listener's
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    job()
    return total() - before


def texts(n: int, size: int) -> list[str]:
    rng = random.Random(4)
    return [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(size // 10)) for _ in range(n)]


def test_reconcile_moves_a_text_to_the_row_that_takes_it_alone(spark):
    said = texts(200, 5_000)
    rows = spark.createDataFrame([(i, f"lang{i // 4}-{i}", t) for i, t in enumerate(said)], "i long, name string, description string").withColumn("triggers", F.array(F.lit("a"))).withColumn("ord", F.col("name"))
    rows = tabled(rows)
    listed = rows.filter("i % 2 = 0").withColumn("visibility", F.lit("ready"))
    disk = rows.withColumn("path", F.concat(F.lit("/"), "name")).withColumn("mtime", F.col("i"))
    last = tabled(catalog.reconcile(listed, disk))
    moved = shuffled(spark, lambda: catalog.reconcile(listed, disk, last).write.format("noop").mode("overwrite").save())
    assert moved < 3 * sum(map(len, said))


def test_search_moves_postings_and_not_pairs(spark):
    """All entries have all terms of all queries; what is shuffled follows the entries' postings, not their pairs with queries."""
    from shelfmark.operators import retrieval

    rng, words = random.Random(5), [f"word{i}" for i in range(40)]
    rows = [(f"skill:n{i}", f"n{i}", f"skill n{i}", " ".join(rng.sample(words, 40))) for i in range(400)]
    e = spark.createDataFrame(rows, "id string, name string, ord string, description string").selectExpr("*", "cast(null as string) as description_zh", "array('x1') as triggers", "'ready' as visibility", "false as excluded", "true as agent_bound", "false as has_references")
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 8))) for i in range(300)], "qid long, query string")
    postings = 400 * 40
    moved = shuffled(spark, lambda: retrieval.scored(tabled(q), tabled(e)).write.format("noop").mode("overwrite").save())
    print("moved", moved)
    assert moved < 40 * postings


def test_similar_pairs_move_no_frequent_terms(spark):
    """Terms of nearly all skills, most postings, can make no pair and stay where they are."""
    from shelfmark.operators import graph

    rows = [(f"s{i}", f"common{j}") for i in range(600) for j in range(200)] + [(f"s{i}", f"rare{i // 3}-{j}") for i in range(600) for j in range(4)]
    posted = tabled(spark.createDataFrame(rows, "skill string, term string"))
    found = []
    moved = shuffled(spark, lambda: found.extend(graph.similar_pairs(posted).collect()))
    assert len(found) == 600 and moved < 5 * len(rows)
