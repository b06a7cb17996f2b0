"""N-gram Jaccard join of texts by chosen paths.

A text is the set of its five-word shingles; sets that are equal are one node from the start. Each run splits the nodes
by a shared token, drawn as a minimum over a hash, and buckets that are still large by another one, which the path so far
chooses, up to a depth. Small buckets, and those that stay large as their members are alike, are compared by brute force
on the whole sets. A pair of similarity s meets in a run with probability s**depth at least, so as many runs are made as
the target recall takes. A pair is counted in the first run in which it meets, so no pair ever becomes a row: a bucket
returns for each member how many documents it is linked to, and a tree of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import dropped, free_name, mask_of, masked, parted, scratch_dir, slices, tidy, written
from shelfmark.llm.components import components
from shelfmark.llm.hashing import mix, odd_constants, shingle_sets

SIMILARITY = 0.8
SHINGLE = 5
RECALL = 0.9999
DEPTH = 3
TOKENS = 64  # minima kept of each set
SMALL = 32  # members up to which a bucket is not split
BLOCK = 1000  # members, and
BLOCK_HASHES = 400_000  # shingles, that one comparison takes of each side


def runs_for(recall: float, similarity: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    both = np.array([mix(hashes).sum(), mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(), len(hashes)], np.uint64)
    return int(mix((both * odd_constants(3, 11)).sum(keepdims=True)).astype(np.int64)[0])


def minima(hashes: np.ndarray, tokens: int) -> np.ndarray:
    """For each of `tokens` hash functions the least value over the set."""
    factors, out = odd_constants(tokens, 23), np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 512):
        part = hashes[a : a + 512, None] * factors
        part ^= part >> np.uint64(29)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def paths(minima_of: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """The path of each set (row) in each run at each depth: shape sets x runs x depth."""
    n, tokens = minima_of.shape
    out = np.empty((n, runs, depth), np.uint64)
    rows = np.arange(n)
    for r in range(runs):
        path = np.full(n, r + 1, np.uint64)
        at = np.full(n, r % tokens)
        for level in range(depth):
            path = mix(path * np.uint64(0x9E3779B97F4A7C15) + mix(minima_of[rows, at] + np.uint64(level)))
            out[:, r, level] = path
            at = (runs + (path >> np.uint64(33)) % np.uint64(max(1, tokens - runs))).astype(int) % tokens
    return out


def compare(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, ids: np.ndarray, run: int, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each member the documents linked to it in this run first, and the least node of its tree of links.

    side: where given, only pairs of different sides count (a block of a large bucket against another).
    """
    k = len(nodes)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((k, k), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        wide = max(1, min(int(column[-1]) + 1, 8_000_000 // k))
        for a in range(0, int(column[-1]) + 1, wide):
            lo, hi = np.searchsorted(column, (a, a + wide))
            there = np.zeros((k, wide), np.float32)
            there[owner[lo:hi], column[lo:hi] - a] = 1
            both += there @ there.T
    # Counts are whole in float32; the limit is in float64, as a step of float32 at large sizes is more than the slack.
    share = sizes.astype(float) * (similarity / (1 + similarity))
    alike = both >= share[:, None] + (share - 1e-6)[None, :]
    i, j = np.nonzero(np.triu(alike, 1))
    if run and len(i):
        earlier = np.zeros(len(i), bool)
        for r in range(run):
            earlier |= (ids[i, r] == ids[j, r]) & (ids[i, r] != 0)
        i, j = i[~earlier], j[~earlier]
    if side is not None:
        across = side[i] != side[j]
        i, j = i[across], j[across]
    links = np.bincount(i, weights[j], k) + np.bincount(j, weights[i], k)
    label = nodes.copy()
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        if np.array_equal(label, before):
            break
    return links.astype(np.int64), label


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, n_shingles for each row of docs.

    n_links: other rows of similarity from `similarity` on, copies included; class_id: the least doc_id that links lead
    to; copy_of: the least doc_id of an equal set. Words are lower-cased runs of letters and digits; texts of fewer than
    k words are one shingle; null texts and texts without words link to nothing. Rows of one doc_id are rows of their
    own; a null doc_id is no class's least unless all of it are null. An empty table gives no rows. Options are those of
    `classified`.
    """
    return classified(docs, **options).select("doc_id", "class_id", "n_links", "copy_of", "n_shingles")


def classified(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, recall: float = RECALL, depth: int = DEPTH, tokens: int = TOKENS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """The columns of `join`, and of each row _row (a hash of its doc_id and text), worded, and stays.

    stays: whether the row has no words, or is the first of its class by doc_id (null last), then by _row.
    """
    spark = docs.sparkSession
    runs = runs_for(recall, similarity, depth)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                nodes, sizes, mins = [], [], []
                for h in shingle_sets(texts, k):
                    nodes.append(node_of(h) if len(h) else None)
                    sizes.append(len(h))
                    mins.append(minima(h, tokens))
                way = paths(np.array(mins, np.uint64).reshape(-1, tokens), runs, depth).astype(np.int64)
                offsets = pa.array(np.arange(len(way) + 1) * runs * depth, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(way.reshape(-1)))], names=["_row", "doc_id", "node", "n", "way"])

    sketched = written(rows.mapInArrow(tidy(sketch), "_row bigint, doc_id bigint, node bigint, n bigint, way array<bigint>"))
    nodes = sketched.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("copy_of"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first"), F.count("*").alias("weight"), F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("way").alias("way"))
    nodes = written(nodes)
    way = lambda level: F.get("way", F.col("run") * depth + level)
    steps = nodes.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "way").select("node", "n", F.col("run"), *[way(x).alias(f"p{x}") for x in range(depth)])
    # Down each path as far as its bucket is large.
    steps = steps.withColumn("bucket", F.col("p0"))
    for level in range(1, depth):
        large = steps.groupBy("bucket").agg(F.count("*").alias("_c")).filter(F.col("_c") > small).select(F.col("bucket").alias("_b"))
        steps = steps.join(large, F.col("bucket") == F.col("_b"), "left").withColumn("bucket", F.when(F.col("_b").isNotNull(), F.col(f"p{level}")).otherwise(F.col("bucket"))).drop("_b")
    steps_at, placed_at = scratch_dir(spark), scratch_dir(spark)
    steps = written(steps.select("node", "n", "run", "bucket"), steps_at)
    met = steps.groupBy("bucket").agg(F.count("*").alias("_c")).filter("_c > 1").select(F.col("bucket").alias("_b"))
    placed = steps.join(met, F.col("bucket") == F.col("_b"), "left_semi")
    ids = F.array(*[F.coalesce(F.max(F.when(F.col("run") == r, F.col("bucket"))), F.lit(0)) for r in range(runs)])
    placed = written(placed.groupBy("node").agg(F.first("n").alias("n"), ids.alias("ids")), placed_at)
    dropped(spark, steps_at)
    member = placed.select("node", "n", "ids", F.posexplode("ids").alias("run", "bucket")).filter("bucket <> 0")
    # A bucket whose members all share one of an earlier run has nothing to add.
    told = member.groupBy("run", "bucket").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"), *[F.min(F.get("ids", F.lit(r))).alias(f"lo{r}") for r in range(runs)], *[F.max(F.get("ids", F.lit(r))).alias(f"hi{r}") for r in range(runs)])
    again = F.lit(False)
    for r in range(runs - 1):
        again = again | ((F.col("run") > r) & (F.col(f"lo{r}") == F.col(f"hi{r}")) & (F.col(f"lo{r}") != 0))
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
    units = told.filter(~again).select(F.col("run").alias("_run"), F.col("bucket").alias("_bucket"), parts.alias("parts"))
    chosen = member.join(units, (F.col("run") == F.col("_run")) & (F.col("bucket") == F.col("_bucket"))).select("node", "ids", "run", "bucket", "parts")
    by_node = written(chosen.groupBy("node").agg(F.first("ids").alias("ids"), F.collect_list(F.struct("run", "bucket", "parts")).alias("units")).join(nodes.select("node", "weight", "_row"), "node"))
    dropped(spark, placed_at)
    # Whole sets of the nodes that meet another; a mask keeps most other texts out of the shuffle.
    shared = spark.sparkContext.broadcast(mask_of(by_node.select("_row")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(masked(batch.column(0).to_numpy(), mask)))
            for part, texts in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.astype("<u8").tobytes() for h in shingle_sets(texts, k)], pa.binary())], names=["_row", "set"])

    sets = rows.mapInArrow(tidy(whole), "_row bigint, set binary").dropDuplicates(["_row"])
    full = by_node.join(sets, "_row").select("node", "weight", "ids", "set", F.explode("units").alias("u")).select("node", "weight", "ids", "set", "u.*")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    dealt = full.withColumn("own", own).withColumn("ab", F.explode(blocks)).select("run", "bucket", "ab.a", "ab.b", "own", "node", "weight", "ids", "set")
    dealt = dealt.repartition("run", "bucket", "a", "b").sortWithinPartitions("run", "bucket", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members = None, []
        found: list[tuple] = []

        def close() -> None:
            if len(members) > 1:
                node = np.array([m[1] for m in members], np.int64)
                sets = [np.frombuffer(m[4], "<u8") for m in members]
                side = np.array([m[0] for m in members]) if unit[2] != unit[3] else None
                links, label = compare(node, np.array([len(s) for s in sets]), sets, np.array([m[2] for m in members], float), np.array([m[3] for m in members], np.int64), unit[0], side, similarity)
                found.extend((n, c, b) for n, c, b in zip(node.tolist(), links.tolist(), label.tolist()) if c)

        for batch in batches:
            for run, bucket, a, b, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (run, bucket, a, b) != unit:
                    close()
                    unit, members = (run, bucket, a, b), []
                members.append(member)
            if found:
                yield _links(found)
                found = []
        close()
        if found:
            yield _links(found)

    links = written(dealt.mapInArrow(tidy(verify), "node bigint, links bigint, label bigint"))
    labels = components(links.select(F.col("node").alias("u"), F.col("label").alias("v")))
    per_node = nodes.select("node", "copy_of", "first", "weight").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(labels, "node", "left")
    per_node = per_node.withColumn("label", F.coalesce("label", "node"))
    classes = per_node.groupBy("label").agg(F.min("first").alias("head"))
    per_node = per_node.join(classes, "label").select("node", "head", "copy_of", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # Nothing is grouped after this join, so adaptive execution splits a node of very many copies.
    out = sketched.select("_row", "doc_id", "node", F.col("n").alias("n_shingles")).join(per_node, "node", "left")
    worded = F.col("node").isNotNull()
    return out.select(
        "_row", "doc_id", F.when(worded, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(worded, F.col("copy_of")).otherwise(F.col("doc_id")).alias("copy_of"), "n_shingles", worded.alias("worded"), (~worded | (F.col("_row") == F.col("head._row"))).alias("stays"))


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["node", "links", "label"])


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all its columns, unchanged: that of the least doc_id.

    A null doc_id comes last; rows of one doc_id are told apart by a hash of their text, and one of a class stays. Of rows
    repeated in doc_id and text one stays, whichever its other columns. All rows without words stay.
    """
    marks = written(classified(docs, **options).select("_row", "worded", "stays"))
    spare = marks.filter(~F.col("stays")).select(F.col("_row").alias("_spare")).distinct()
    again = marks.filter(F.col("worded") & F.col("stays")).groupBy("_row").count().filter("count > 1").select(F.col("_row").alias("_again"))
    mark = free_name(docs, "_mark")
    some, others = parted(docs.withColumn(mark, F.xxhash64("doc_id", "text")), F.col(mark), spare.unionByName(again.withColumnRenamed("_again", "_spare")))
    some = some.join(spare, some[mark] == spare["_spare"], "left_anti")
    is_again = F.col(mark) == again["_again"]
    once = some.join(again, is_again, "left_semi").dropDuplicates([mark])
    return others.unionByName(some.join(again, is_again, "left_anti")).unionByName(once).drop(mark)


#: All pairs that share a shingle, and classes by walking links; doc_ids are taken to be there and to differ, as the given tables have them.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END)) AS h FROM d
), s AS (SELECT doc_id, unnest(h) AS h FROM sets),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v WHERE 5 * c >= 4 * (len(a.h) + len(b.h) - c)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT walk.a, l.v FROM walk JOIN l ON l.u = walk.b)
SELECT doc_id, (SELECT min(b) FROM walk WHERE a = sets.doc_id) AS class_id, (SELECT count(*) FROM l WHERE u = sets.doc_id) AS n_links,
  CASE WHEN len(h) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(h, ','))) END AS copy_of, CAST(len(h) AS BIGINT) AS n_shingles
FROM sets
"""
