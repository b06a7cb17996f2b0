"""Benchmark decontamination as a prefix-filtered set join of item-sized windows with documents.

A window's words are ordered by rarity, counted over all documents. Since all of them must occur for the window to, the
prefix that has to be joined is the rarest word alone; length and position bounds leave one place for each occurrence of
that word, and the exact words there decide. Benchmark items go out in blocks of a bounded number of characters, each a
stated query set against all documents, so no broadcast grows with a table.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import dealt_join, free_name, parted, slices, text_key, tidy, whole_text, written
from shelfmark.llm.hashing import ALNUM_LOWER

WINDOW = 13
SHARE = 20  # a document is contaminated from a twentieth of its words
BLOCK_CHARS = 8_000_000


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters and digits of ASCII and of all other characters."""
    return text.translate(ALNUM_LOWER).split()


def words_of(text: str | None) -> list[bytes]:
    return split_words(text.encode()) if text else []


@dataclass
class Index:
    """Windows of one block of items by their rarest word, and its place in them."""

    items: dict[tuple, list[str]] = field(default_factory=lambda: defaultdict(list))  # window: items
    by_word: dict[bytes, dict[tuple[int, int], set]] = field(default_factory=dict)  # word: (place, length): windows


def windows_of(words: list[bytes], k: int) -> set[tuple]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def build_index(items: list[tuple[str, list[bytes]]], rarity: Counter, k: int) -> Index:
    index = Index()
    for item, words in items:
        for w in windows_of(words, k):
            if item not in index.items[w]:
                index.items[w].append(item)
    for w in index.items:
        place = min(range(len(w)), key=lambda i: (rarity[w[i]], w[i], i))
        index.by_word.setdefault(w[place], {}).setdefault((place, len(w)), set()).add(w)
    return index


def hits_of(words: list[bytes], index: Index) -> tuple[list[int], list[int], set[str]]:
    """Starts and ends, in words, of occurring windows in order of start, and the items they are from."""
    common = index.by_word.keys() & set(words)
    starts, ends, items = [], [], set()
    if not common:
        return starts, ends, items
    n = len(words)
    for p, word in enumerate(words):
        if word in common:
            for (place, k), windows in index.by_word[word].items():
                a = p - place
                if a >= 0 and a + k <= n and (w := tuple(words[a : a + k])) in windows:
                    starts.append(a)
                    ends.append(a + k)
                    items.update(index.items[w])
    return starts, ends, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any span."""
    total, until = 0, 0
    for a, b in sorted(spans):
        if b > until:
            total += b - max(a, until)
            until = b
    return total


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[str, list[bytes]]]]:
    """Items in blocks; each is collected by itself and bounded, but for one item that is longer."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars) or 1
    for b in range(n):
        here = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(item, words_of(text)) for item, text in here.collect()]


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> Counter:
    """In how many of all documents each word of a bounded vocabulary occurs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = shared.value, Counter()
        for batch in batches:
            for _, texts in slices(batch, 0):
                for t in texts:
                    seen.update(vocab & set(split_words(t)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(tidy(count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(w): n for w, n in counted.collect()})


def _judged(docs: DataFrame, benchmark: DataFrame, k: int, share: int, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, _h1, _h2, n_words of each row of docs; and of each text with hits its _h1, _h2, n_hit, n_items, items_sha256, contaminated.

    A block of items is searched, its hits are written and its index given up before the next one is made, so only one is in
    memory. Hits are told by two hashes of the text, so nothing depends on the order of rows; equal texts are judged once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), *text_key(F.col("text")))
    every, hits = None, None
    for items in _blocks(benchmark, block_chars):
        index_of = spark.sparkContext.broadcast(build_index(items, document_frequency(docs, {w for _, words in items for w in words}), k))

        def search(batches: Iterator[pa.RecordBatch], index_of=index_of, all_rows=every is None) -> Iterator[pa.RecordBatch]:
            index = index_of.value
            for batch in batches:
                for part, texts in slices(batch, 1):
                    n_words, spans, named = [], [], []
                    for t in texts:
                        words = split_words(t)
                        starts, ends, items = hits_of(words, index)
                        n_words.append(len(words))
                        spans.append([x for span in zip(starts, ends) for x in span])
                        named.append(sorted(items))
                    out = pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.string()))], names=["doc_id", "_h1", "_h2", "n_words", "spans", "items"])
                    yield out if all_rows else out.filter(pa.array([bool(x) for x in named], pa.bool_()))

        found = written(rows.mapInArrow(tidy(search), "doc_id bigint, _h1 bigint, _h2 bigint, n_words bigint, spans array<int>, items array<string>"))
        index_of.destroy()
        every = found.select("doc_id", "_h1", "_h2", "n_words") if every is None else every
        once = found.filter("size(items) > 0").groupBy("_h1", "_h2").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"))
        hits = once if hits is None else hits.unionByName(once)
    hits = hits.groupBy("_h1", "_h2").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row for each block at most

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [covered(list(zip(x[::2], x[1::2]))) for x in batch.column(3).to_pylist()]
            items = batch.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                 pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, batch.column(2).to_pylist())], pa.bool_())],
                names=["_h1", "_h2", "n_hit", "n_items", "items_sha256", "contaminated"])

    return every, hits.mapInArrow(tidy(close), "_h1 bigint, _h2 bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, share: int = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    Null and empty texts have no words and no hits; items without words have no windows; equal windows of several items
    count for each; repeated items count once; a null item_id goes by the name null; repeated rows and null doc_ids keep
    their rows; an empty table on either side gives rows without hits or none. Other columns are not read. Of very many
    copies of one text no more than their keys meet.
    """
    every, hits = _judged(docs, benchmark, k, share, block_chars)
    both = dealt_join(every, written(hits), ["_h1", "_h2"], every.count())
    zero = F.lit(0).cast("bigint")
    return both.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, share: int = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, unchanged, whatever their names.

    Each row is judged by its own text, known by two hashes; null and empty texts stay, an empty table stays empty, and
    all repeated rows stay or go together. Only rows whose text may be one of the contaminated ones are shuffled.
    """
    _, hits = _judged(docs, benchmark, k, share, block_chars)
    bad = written(hits.filter("contaminated").select(F.col("_h1").alias("_bad"), F.col("_h2").alias("_bad2")))
    one, two = free_name(docs, "_h1"), free_name(docs, "_h2")
    h1, h2 = text_key(docs["text"])
    some, others = parted(docs.withColumn(one, h1).withColumn(two, h2), F.col(one), bad.select("_bad"))
    kept = some.join(bad, (some[one] == bad["_bad"]) & (some[two] == bad["_bad2"]), "left_anti")
    return others.unionByName(kept).drop(one, two)


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
doc_windows AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM doc_words, lengths, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(i) WHERE len(w) >= k),
hits AS (SELECT d.rid, d.i, d.k, b.item FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.s = b.s),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
