"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is retained.

Sketches of any two documents can be merged by union and compared however unequal the documents are. A fingerprint is
``shingles:hash of all:sketch``; the sketch is base64 of sorted little-endian 64-bit hashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import shuffle_width, slices, tidy, whole_text
from shelfmark.llm.hashing import mix, shingle_sets

FRACTION = 0.25
SHINGLE = 5


class Sketch:
    __slots__ = ("kept", "n", "whole")

    def __init__(self, hashes: np.ndarray, fraction: float) -> None:
        self.n = len(hashes)
        self.whole = int(mix(hashes).sum()) if self.n else 0
        self.kept = hashes[: np.searchsorted(hashes, np.uint64(int(fraction * (2**64 - 1))))]

    def text(self) -> str:
        return f"{self.n}:{self.whole:016x}:{base64.b64encode(self.kept.astype('<u8').tobytes()).decode()}"


def parse(fingerprint: str) -> tuple[int, str, np.ndarray]:
    n, whole, kept = fingerprint.split(":")
    return int(n), whole, np.frombuffer(base64.b64decode(kept), "<u8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents' shingles together."""
    return np.union1d(a, b)


def likeness(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimated Jaccard similarity, and containment of a in b. Where neither retains a hash, equal sets alone are alike."""
    if a.whole == b.whole and a.n == b.n:
        return 1.0, 1.0
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    either = len(a.kept) + len(b.kept) - both
    return both / either if either else 0.0, both / len(a.kept) if len(a.kept) else 0.0


def fingerprint(docs: DataFrame, fraction: float = FRACTION, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of each row, without a shuffle.

    Null text counts as empty, and an empty text has the fingerprint of no shingles; texts of any length are taken whole;
    repeated rows and null keys give a row each; an empty table gives none; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Sketch(h, fraction).text() for h in shingle_sets(texts, k)], pa.string())], names=[key, "fingerprint"])

    return docs.select(key, whole_text(text).alias("_text")).mapInArrow(tidy(work), f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint string")


def edited(own: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many first ones of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


NO_ID = (1 << 63) - 1  # where a null doc_id stands among bitwise complements of others


def _image(text: Column) -> Column:
    """The first seven bytes as a number: it ascends with texts."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def _spot(a: Column, b: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the ascending cuts stand at (a, b) or before it, by halving."""
    first, second = (F.array(*[F.lit(c[i]).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))])

    def halve(at: Column, step: Column) -> Column:
        x, y = F.get(first, at + step - 1), F.get(second, at + step - 1)  # null beyond the last
        return F.when((x < a) | ((x == a) & (y <= b)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def _cuts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Fewer than parts places (a, b) that share rows out evenly; a value of a that holds several shares is cut by b."""
    found = rows.agg(F.percentile_approx("a", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    shares = Counter(found or [])
    many = [a for a, n in shares.items() if n > 1]  # each holds a share of rows at least, so they are fewer than parts
    cuts = [(a, -1) for a in shares]
    if many:
        most = max(shares.values())
        within = rows.filter(F.col("a").isin(many)).groupBy("a").agg(F.percentile_approx("b", [i / most for i in range(1, most)], 20 * most).alias("q"))
        for a, q in within.collect():
            cuts += [(a, q[i * most // shares[a] - 1]) for i in range(1, shares[a])]
    return sorted(set(cuts))


def with_edits(docs: DataFrame, fraction: float = FRACTION, k: int = SHINGLE) -> DataFrame:
    """Fingerprints of each document and of its text edited with the next document's, and their likeness.

    The next document is that of the next smaller doc_id; after the last comes the first. Rows of one doc_id follow each
    other by text; a null doc_id comes last; null text is empty; an empty table gives no rows; a lone document follows
    itself; other columns are not read. Rows are dealt once by ranges of doc_id, and of texts where very many rows have
    one doc_id or none; each range also gets the first document of the next one.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit(NO_ID)).alias("a"), _image(text).alias("b"))
    parts = shuffle_width(spark)
    cuts = _cuts(rows.select("a", "b"), parts)
    spot = _spot(F.col("a"), F.col("b"), cuts)
    heads = sorted((r.spot, r.h.a, r.h.b) for r in rows.select("a", "b", spot.alias("spot")).groupBy("spot").agg(F.min(F.struct("a", "b")).alias("h")).collect())  # a row for each range
    at = {s: (a, b, before) for (s, a, b), (before, _, _) in zip(heads, [heads[-1], *heads[:-1]] if heads else [])}
    known = [F.array(*[F.lit(at[s][i] if s in at else None).cast("bigint") for s in range(len(cuts) + 1)]) for i in range(3)]
    is_head = (F.get(known[0], F.col("spot")) == F.col("a")) & (F.get(known[1], F.col("spot")) == F.col("b"))
    copy = F.when(is_head, F.get(known[2], F.col("spot")).cast("int"))
    places = F.filter(F.array(F.struct(F.col("spot").alias("spot"), F.lit(0).alias("borrowed")), F.struct(copy.alias("spot"), F.lit(1).alias("borrowed"))), lambda p: p["spot"].isNotNull())
    dealt = (
        rows.withColumn("spot", spot).withColumn("place", F.explode(places)).select("doc_id", "text", "place.spot", "place.borrowed")
        .repartitionById(max(parts, len(cuts) + 1), "spot").sortWithinPartitions("spot", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited", "contained_in_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]

    def finish(ids: list, texts: list[str]) -> pa.RecordBatch:
        """texts has one more, which follows the last."""
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
        own = [Sketch(h, fraction) for h in shingle_sets([t.encode() for t in texts], k)]
        new = [Sketch(h, fraction) for h in shingle_sets(changed, k)]
        near, following = [likeness(a, b) for a, b in zip(own, new)], [likeness(a, b) for a, b in zip(own, own[1:])]
        columns = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(c).hexdigest() for c in changed], [s.text() for s in own[:-1]], [s.text() for s in new], [x for x, _ in near], [x for x, _ in following], [x for _, x in near], [x for _, x in following]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        at, size, closed = None, 0, False
        for batch in batches:
            for doc_id, text, spot, borrowed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if spot != at:
                    at, closed = spot, False
                if closed:
                    continue
                texts.append(text)
                size += len(text)
                if borrowed or (size > 1 << 20 and len(texts) > 1):
                    if len(texts) > 1:
                        yield finish(ids, texts)
                    ids, texts, size, closed = [], [] if borrowed else [text], 0, bool(borrowed)
                if not borrowed:
                    ids.append(doc_id)

    return dealt.mapInArrow(tidy(work), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double, contained_in_next double")
