"""Packing of documents into token sequences by cutting-stock column generation.

Whole sequences are cut off a document first; what remains of it, its rest, is shorter than a sequence. The histogram of
rests, in units of a few tokens, is all the linear program sees: its columns are patterns of rests that fill a sequence,
priced by a knapsack dynamic program over the duals. Rounded patterns that fill a sequence are dealt to the documents
ranked within their length class. Rests that no such pattern takes are laid end to end and cut at sequence ends, so they
pad one sequence. The histogram and the patterns are bounded by the sequence length; nothing per document comes to the
driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import shuffle_width, slices, tidy, whole_text, written
from shelfmark.llm.tokens import BYTE_BPE, encoder

WIDTH = 2048
UNIT = 4  # tokens; rests are rounded up to it within patterns
END_ID = 1
MOST_COLUMNS = 3_000
FILL = 0.995  # of a sequence, from which a pattern is used
GAP = 1e-3  # columns are generated until the bound is so near


@dataclass
class Pattern:
    count: int  # sequences filled so
    parts: dict[int, int]  # class: rests of it in a sequence


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest sum of duals within room, by unbounded knapsack; sizes ascend."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - sizes[:k]] + duals[:k]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], taken[c] = value[j], j
    column, c = np.zeros(len(sizes)), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            column[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(best[room]), column


def _product(subscripts: str, *arrays: np.ndarray) -> np.ndarray:
    """A product of arrays without BLAS, whose threads may hang in a driver that has forked to start its JVM."""
    return np.einsum(subscripts, *arrays, optimize=False)


def _inverse(columns: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """The inverse of a basis that is lower triangular once its rows are in the order in which classes ended."""
    lower, solved = columns[ended], np.zeros_like(columns)
    for i in range(len(lower)):
        solved[i, i] = 1
        if i:
            solved[i] -= _product("i,ij->j", lower[i, :i], solved[:i])
        solved[i] /= lower[i, i]
    inverse = np.empty_like(solved)
    inverse[:, ended] = solved
    return inverse


def solve(demand: dict[int, int], room: int, most_columns: int = MOST_COLUMNS, gap: float = GAP, fill: float = FILL) -> tuple[list[Pattern], float]:
    """Patterns that fill a sequence, with whole counts that no class's demand falls short of, and the linear program's bound on sequences."""
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return [], 0.0
    d = np.array([demand[s] for s in sizes], float)
    # A first basis: the fullest pattern of what is left, large rests first, until it uses up a class, and so on; each
    # pattern ends a class that no later one has, so the columns are triangular.
    columns, x, cost, rest = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes)), np.ones(len(sizes)), d.copy()
    open_, ended = np.ones(len(sizes), bool), []
    for i in range(len(sizes)):
        here = np.flatnonzero(open_)
        _, part = price(sizes[here] * (1.0 + 1e-3 * sizes[here] / room), sizes[here], room)
        columns[here, i] = part
        times = np.where(part > 0, rest[here] / np.where(part > 0, part, 1), np.inf)
        ends = int(times.argmin())
        x[i] = times[ends]
        rest[here] = np.maximum(rest[here] - x[i] * part, 0)
        open_[here[ends]] = False
        ended.append(here[ends])
    inverse = _inverse(columns, np.array(ended))
    bound = 0.0
    for _ in range(most_columns):
        duals = _product("i,ij->j", cost, inverse)
        least = int(duals.argmin())
        if duals[least] < -1e-9:  # too much of a class may be cut: its surplus enters, so duals stay in bounds
            column, price_of = np.zeros(len(sizes)), 0.0
            column[least] = -1.0
        else:
            duals = np.maximum(duals, 0)
            value, column = price(duals, sizes, room)
            price_of = 1.0
            bound, used_up = max(bound, float((duals * d).sum()) / max(value, 1.0)), float((cost * x).sum())
            if value <= 1 + 1e-9 or used_up - bound <= gap * used_up:
                break
        u = _product("ij,j->i", inverse, column)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * u, 0)
        x[out] = step
        inverse[out] /= u[out]
        others = u.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        columns[:, out], cost[out] = column, price_of
    x, columns = x[cost > 0], columns[:, cost > 0]
    left = d.astype(int)
    counts = np.floor(x + 1e-9).astype(int)
    for i in np.argsort(-x, kind="stable"):  # rounding errors must not overdraw a class
        used = columns[:, i].astype(int)
        counts[i] = min(counts[i], int(np.min(left[used > 0] // used[used > 0]))) if used @ sizes >= fill * room else 0
        left -= counts[i] * used
    for i in np.argsort(counts - x, kind="stable"):  # most of a sequence lost to rounding first: once more where demand is left
        used = columns[:, i].astype(int)
        if np.all(left >= used) and used @ sizes >= fill * room:
            counts[i] += 1
            left -= used
    return [Pattern(int(n), {int(sizes[c]): int(columns[c, i]) for c in np.flatnonzero(columns[:, i])}) for i, n in enumerate(counts) if n], bound


def measure(docs: DataFrame, tokenizer: str, width: int, end_id: int) -> DataFrame:
    """_row, doc_id, n (ids with the end id), crcs (of whole sequences, then of the rest), ids (of the rest) of each row."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer), 4 * width
        for batch in batches:
            for part, texts in slices(batch, 2):
                lengths, crcs, rests = [], [], []
                for ids in encode.ids(texts):
                    raw = ids.astype("<u4").tobytes() + end
                    lengths.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[a : a + step]) for a in range(0, len(raw), step)])
                    rests.append(raw[len(raw) // step * step :])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], names=["_row", "doc_id", "n", "crcs", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(tidy(work, keep_tokens=True), "_row bigint, doc_id bigint, n bigint, crcs array<bigint>, ids binary")


def _running(rows: DataFrame, amount: str, within: list[str], salts: int, name: str) -> DataFrame:
    """rows with the sum of `amount` over all rows before, within equal `within`; in two steps, so no key meets in one task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    sums = salted.groupBy(*within, "_salt").agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*within).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*within, "_salt").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    both = salted.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(F.broadcast(sums), [*within, "_salt"])  # a row for each class and salt at most
    return both.withColumn(name, F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_salt")


def pack(docs: DataFrame, width: int = WIDTH, tokenizer: str = BYTE_BPE, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each row of docs.

    Null and empty texts are the end id alone; repeated rows and null doc_ids are packed as rows of their own; an empty
    table gives no pieces; a text of any length is cut into whole sequences and a rest. Other columns are not read.
    """
    spark, salts = docs.sparkSession, shuffle_width(docs.sparkSession)
    measured = written(measure(docs, tokenizer, width, end_id))
    rows = measured.drop("ids").withColumn("rest", (F.col("n") % width).cast("int")).withColumn("full", F.floor(F.col("n") / width).cast("bigint"))
    size = F.ceil(F.col("rest") / unit).cast("int")
    rests = rows.filter("rest > 0").withColumn("size", size)
    histogram = {r["size"]: r["n"] for r in rests.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most width / unit rows
    patterns, _ = solve(histogram, width // unit)
    slots, base, given = [], 0, {}
    for p in patterns:
        for place, (s, times) in enumerate(sorted(p.parts.items(), reverse=True)):
            lo = given.get(s, 0)
            given[s] = lo + p.count * times
            slots.append((s, lo, given[s], base, times, place))
        base += p.count
    slots_df = spark.createDataFrame(slots, "size int, lo bigint, hi bigint, base bigint, times int, place int")
    ranked = _running(rests.withColumn("one", F.lit(1)), "one", ["size"], salts, "rank").drop("one").select("_row", "doc_id", "n", "crcs", "rest", "full", "size", "rank")
    end_crc = F.element_at("crcs", -1)
    taken = F.element_at(F.create_map(*[F.lit(x) for s, n in given.items() for x in (s, n)]), F.col("size")) if given else F.lit(None)
    taken = F.coalesce(taken, F.lit(0))
    ranked = ranked.withColumn("patterned", F.col("rank") < taken)
    # Rests in patterns.
    dealt = ranked.filter("patterned").join(F.broadcast(slots_df), "size").filter("rank >= lo and rank < hi")
    dealt = dealt.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("times")))
    before = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    in_patterns = dealt.withColumn("offset", F.coalesce(F.sum("rest").over(before), F.lit(0))).select(
        "doc_id", (F.col("full") * width).alias("start"), F.col("rest").cast("bigint").alias("length"), end_crc.alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", F.col("offset").cast("bigint").alias("offset"))
    # The others, end to end.
    left = ranked.filter("not patterned").select("_row", "doc_id", "n", "crcs", "rest", "full", F.lit(0).alias("all"))
    laid = written(_running(left, "rest", ["all"], salts, "at").select("_row", "doc_id", "n", "crcs", "rest", "full", "at"))
    line = laid.agg(F.max(F.col("at") + F.col("rest"))).first()[0] or 0
    lines = -(-line // width)
    cells = laid.withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("rest") - 1) / width))))
    a, b = F.greatest(F.col("at"), F.col("cell") * width), F.least(F.col("at") + F.col("rest"), (F.col("cell") + 1) * width)
    cells = cells.select("_row", "doc_id", (F.col("full") * width + a - F.col("at")).alias("start"), (b - a).alias("length"), (a - F.col("at")).alias("skip"), F.when(b - a == F.col("rest"), end_crc).alias("whole_crc"), F.col("n").alias("doc_tokens"), (F.col("cell") + base).alias("sequence_id"), (a - F.col("cell") * width).alias("offset"))
    at_end = cells.filter("whole_crc is not null").withColumn("ids_crc32", F.col("whole_crc"))
    loose = [s for s, n in histogram.items() if n > given.get(s, 0)]
    ids = measured.filter(F.ceil((F.col("n") % width) / unit).cast("int").isin(loose)).select("_row", "ids")
    piece = F.substring(F.col("ids"), (4 * F.col("skip") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    halves = cells.filter("whole_crc is null").join(ids, "_row").withColumn("ids_crc32", F.crc32(piece))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # Whole sequences.
    long = _running(rows.filter("full > 0").withColumn("all", F.lit(0)), "full", ["all"], salts, "at")
    whole = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1))).select(
        "doc_id", (F.col("k") * width).alias("start"), F.lit(width).cast("bigint").alias("length"), F.get("crcs", F.col("k").cast("int")).alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("at") + F.col("k") + base + lines).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return in_patterns.select(*names).unionByName(at_end.select(*names)).unionByName(halves.select(*names)).unionByName(whole.select(*names))
