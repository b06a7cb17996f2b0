"""Removal of repeated passages, with a log-structured index of window hashes.

A window is 20 consecutive words. The index is a list of immutable runs: tables of sorted 64-bit window hashes, each with
16 more bits to verify it by, bucketed by ranges of the hash, with a manifest that is replaced as a whole, so that a later
session can go on with it. A new batch is cut into pieces in order of documents; the distinct hashes of a piece go, sorted,
to their ranges, and there one pass merges the pieces of the batch with the runs before: neither the documents of the index
nor its runs are shuffled. What a range finds goes back to each piece as the hashes that stand in history or in an earlier
piece, and those of which the first stands in this piece. The hashes that are new become a run; runs are compacted into
one when they are many.

No group grows with how often a window occurs: a piece names it once. Pieces and ranges are of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import dropped, scratch_dir, shuffle_width, shuffles_dropped, slices, tidy
from shelfmark.llm.hashing import NOT_SPACE, Words

WINDOW = 20
BATCHES = 4
MOST_RUNS = 2
LEAST_RANGES = 64
RANGE_HASHES = 1 << 22  # that a range is meant to hold at most
ROW_HASHES = 1 << 20
PIECE_BYTES = (4 << 20, 32 << 20)  # least and most of a piece of a batch; a longer text is a piece by itself
NO_ID = (1 << 63) - 1
LATER = 1 << 40  # a place after all starts within a document

RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
_PIECES = "doc_id bigint, _d bigint, text string, piece bigint"
_RUN = "range int, kind int, piece bigint, hashes binary, gone binary, first binary"


def planes(values: np.ndarray) -> bytes:
    """Little-endian bytes of numbers, all first bytes, then all second ones: of sorted numbers the upper ones compress."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def of_planes(raw: bytes | memoryview, kind: str = "<u8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def stored(hashes: np.ndarray, checks: np.ndarray) -> bytes:
    return planes(hashes) + planes(checks)


def restored(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and checks of `stored`: 8 and 2 bytes of each."""
    n = len(raw) // 10
    return of_planes(raw[: 8 * n]), of_planes(raw[8 * n :], "<u2")


def held(ascending: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among ascending ones, and where."""
    at = np.minimum(np.searchsorted(ascending, values), max(len(ascending) - 1, 0))
    return (ascending[at] == values if len(ascending) else np.zeros(len(values), bool)), at


def verified(run: np.ndarray, checks: np.ndarray, hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are in an ascending run with their check; a run may have a hash with several checks."""
    inside, at = held(run, hashes)
    found = inside & (checks[at] == wanted) if len(run) else inside
    left = np.flatnonzero(inside & ~found)
    at = at[left] + 1
    while len(left):
        still = at < len(run)
        still[still] = run[at[still]] == hashes[left[still]]
        left, at = left[still], at[still]
        found[left] = checks[at] == wanted[left]
        left, at = left[~found[left]], at[~found[left]] + 1
    return found


def repeats(keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier, by document, then by start."""
    order = np.lexsort((at, doc, keys))
    k, d, s = keys[order], doc[order], at[order]
    head = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(k)), 0)) if len(k) else np.empty(0, int)
    out = np.empty(len(k), bool)
    out[order] = (d != d[head]) | (s != s[head])
    return out


class Windows:
    """Windows of the texts of a piece: first word of each in the piece, hash, the text's number, and start within it."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.words = Words(texts, NOT_SPACE)
        hashes, whole = self.words.windows(window)
        self.word = np.flatnonzero(whole)
        self.hashes = hashes[self.word]
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.words.last - self.words.first)[self.word]
        self.start = (self.word - self.words.first[self.text]).astype(np.int32)

    def checks(self, window: int) -> np.ndarray:
        return (self.words.windows(window, seed=2)[0][self.word] >> np.uint64(48)).astype("<u2")


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("_d").to_numpy()


def blocks_of(window: int, ranges: int):
    """Of a piece a row for each range: its distinct hashes there, those that it has again, and where those of its first and last document start."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def work(table: pa.Table) -> pa.Table:
        docs, w = _ids(table), Windows(_texts(table), window)
        d = docs[w.text]
        order = np.argsort(w.hashes, kind="stable")
        ordered = w.hashes[order]
        head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, int)
        hashes, firsts = ordered[head], order[head]  # rows ascend by document, so the first is of the least document
        again = np.diff(np.r_[head, len(ordered)]) > 1
        checks = w.checks(window)[firsts]
        # Pieces meet in one document at most, their first or last: only there starts decide which is earlier.
        side = np.where(d[firsts] == docs[0], 1, np.where(d[firsts] == docs[-1], 2, 0)).astype(np.uint8)
        start = w.start[firsts]
        if len(docs) > len(np.unique(docs)):  # of several texts of one document the least start counts
            near = np.flatnonzero((d == docs[0]) | (d == docs[-1]))
            near = near[np.lexsort((w.start[near], d[near], w.hashes[near]))]
            near = near[np.r_[True, w.hashes[near][1:] != w.hashes[near][:-1]]] if len(near) else near
            inside, at = held(hashes, w.hashes[near])
            at, near = at[inside], near[inside]
            same = d[near] == d[firsts[at]]
            start[at[same]] = w.start[near[same]]
        cuts = np.r_[np.flatnonzero(np.r_[True, (hashes[1:] >> shift) != (hashes[:-1] >> shift)]) if len(hashes) else [], len(hashes)].astype(int)
        rows = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            edge = np.flatnonzero(side[a:b])
            rows.append((int(hashes[a] >> shift) if ranges > 1 else 0, stored(hashes[a:b], checks[a:b]), planes(hashes[a:b][again[a:b]]), edge.astype("<i4").tobytes(), side[a:b][edge].tobytes(), start[a:b][edge].astype("<i4").tobytes()))
        piece = table.column("piece")[0].as_py()
        many = len(rows)
        columns = list(zip(*rows)) or [()] * 6
        return pa.table({
            "range": pa.array(columns[0], pa.int32()), "piece": pa.array([piece] * many, pa.int64()), "lo": pa.array([int(docs[0])] * many, pa.int64()), "hi": pa.array([int(docs[-1])] * many, pa.int64()),
            "hashes": pa.array(columns[1], pa.binary()), "again": pa.array(columns[2], pa.binary()), "edge": pa.array(columns[3], pa.binary()), "side": pa.array(columns[4], pa.binary()), "start": pa.array(columns[5], pa.binary())})

    return work


_BLOCKS = "range int, piece bigint, lo bigint, hi bigint, hashes binary, again binary, edge binary, side binary, start binary"


def merged(key: tuple, old: pa.Table | None, new: pa.Table) -> pa.Table:
    """One range: what is new of the batch, for the run, and of each piece the hashes that go and those that stay once."""
    out: list[tuple] = []
    rows = new.to_pylist()
    if rows:
        both = [restored(r["hashes"]) for r in rows]
        hashes, checks = (np.concatenate(c) for c in zip(*both))
        sizes = np.array([len(h) for h, _ in both])
        from_ = np.repeat(np.arange(len(rows)), sizes)
        base = np.cumsum(sizes) - sizes
        order = np.argsort(hashes, kind="stable")
        h, c = hashes[order], checks[order]
        head = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]  # equal in both: the same window
        group = np.cumsum(head) - 1
        h1, c1 = h[head], c[head]
        known = np.zeros(len(h1), bool)
        for raw in old.column("hashes").to_pylist() if old is not None else ():
            if raw:
                known |= verified(*restored(raw), h1, c1)
        many = np.bincount(group) > 1
        # Place of each piece's first occurrence: exact where the document may be another piece's too, else after its first document.
        doc, start = np.array([r["lo"] for r in rows])[from_], np.full(len(hashes), LATER)
        for i, r in enumerate(rows):
            if r["edge"]:
                at = base[i] + np.frombuffer(r["edge"], "<i4")
                doc[at] = np.where(np.frombuffer(r["side"], np.uint8) == 1, r["lo"], r["hi"])
                start[at] = np.frombuffer(r["start"], "<i4")
        shared = np.flatnonzero((many & ~known)[group])
        gone = known[group]
        gone[shared] = repeats(group[shared].astype(np.uint64), doc[order][shared], start[order][shared])
        goes = np.empty(len(hashes), bool)
        goes[order] = gone
        for i, r in enumerate(rows):
            mine, mask = both[i][0], goes[base[i] : base[i] + sizes[i]]
            twice = of_planes(r["again"])
            if len(twice):
                twice = twice[~mask[held(mine, twice)[1]]]
            if mask.any() or len(twice):
                out.append((1, r["piece"], None, planes(mine[mask]), planes(twice)))
        h1, c1 = h1[~known], c1[~known]
        out += [(0, None, stored(h1[a : a + ROW_HASHES], c1[a : a + ROW_HASHES]), None, None) for a in range(0, len(h1), ROW_HASHES)]
    kind, piece, run, go, once = list(zip(*out)) or [()] * 5
    return pa.table({
        "range": pa.array([key[0].as_py()] * len(out), pa.int32()), "kind": pa.array(kind, pa.int32()), "piece": pa.array(piece, pa.int64()),
        "hashes": pa.array(run, pa.binary()), "gone": pa.array(go, pa.binary()), "first": pa.array(once, pa.binary())})


def compacted(ranges: int):
    """One range of several runs in one, as the one or more ranges that it is now; the runs have no hash in common."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        both = [restored(raw) for raw in table.column("hashes").to_pylist()]
        hashes, checks = (np.concatenate(c) for c in zip(*both))
        order = np.argsort(hashes, kind="stable")
        hashes, checks = hashes[order], checks[order]
        of = (hashes >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
        cuts = [*np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist(), len(hashes)] if len(hashes) else [0]
        rows = [(int(of[a]), stored(hashes[a : min(a + ROW_HASHES, b)], checks[a : min(a + ROW_HASHES, b)])) for first, b in zip(cuts, cuts[1:]) for a in range(first, b, ROW_HASHES)]
        none = pa.array([None] * len(rows), pa.binary())
        return pa.table({"range": pa.array([r for r, _ in rows], pa.int32()), "kind": pa.array([0] * len(rows), pa.int32()), "piece": pa.array([None] * len(rows), pa.int64()), "hashes": pa.array([h for _, h in rows], pa.binary()), "gone": none, "first": none})

    return work


def stripped(window: int):
    """A piece's rows less the words of windows that go, or that occur earlier in the piece."""

    def work(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        texts = _texts(table)
        removed = None
        if told.num_rows:
            w = Windows(texts, window)
            gone, twice = (np.sort(np.concatenate([of_planes(x or b"") for x in told.column(c).to_pylist()])) for c in ("gone", "first"))
            goes = held(gone, w.hashes)[0]
            near = np.flatnonzero(held(twice, w.hashes)[0])
            goes[near] |= repeats(w.hashes[near], _ids(table)[w.text[near]], w.start[near])
            at = w.word[goes]
            n = len(w.words.hashes)
            removed = np.cumsum(np.bincount(at, minlength=n + window + 1) - np.bincount(at + window, minlength=n + window + 1))[:n] > 0
            first, last = w.words.first.tolist(), w.words.last.tolist()
        rows: list[list] = [[], [], [], []]
        for i, text in enumerate(texts):
            words = kept = text.split()
            if removed is not None and (mine := removed[first[i] : last[i]]).any():
                kept = list(compress(words, (~mine).tolist()))
            left = b" ".join(kept)
            for column, value in zip(rows, (len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode())):
                column.append(value)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(rows[0], pa.int64()), "n_removed": pa.array(rows[1], pa.int64()), "kept_sha256": pa.array(rows[2], pa.string()), "kept": pa.array(rows[3], pa.string())})

    return work


def ranges_for(size: int) -> int:
    """Ranges, a power of two, for texts of so many bytes."""
    return max(LEAST_RANGES, 1 << (size // 6 // RANGE_HASHES).bit_length())


class FingerprintIndex:
    """Window hashes of all documents so far, in a folder that executors share; opened again, it goes on where it was.

    expected_bytes: of all texts that the index is meant for; ranges are as many as those ask for, and are split when runs are
    compacted after more has come. The manifest names each batch by a key with its run and its pieces, so that a batch that
    comes again, after a driver was lost at whatever moment, gets the answer it got before and joins nothing twice.

    A window is told by 80 bits, 64 of them in a batch's own removal, all from 64-bit hashes of words: at n windows some
    n * n / 2**81 are taken for others.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, most_runs: int = MOST_RUNS, expected_bytes: int = 0) -> None:
        self.spark, self.path, self.most_runs = spark, (path or scratch_dir(spark)).rstrip("/"), most_runs
        found = self._manifests()
        if found:
            state = json.loads(self.spark.read.text(found[max(found)], wholetext=True).first()[0])
            if state["window"] != window:
                raise ValueError(f"the index in {self.path} is of windows of {state['window']} words")
            self.number, self.runs, self.made = max(found), state["runs"], state["made"]
            self.ranges, self.buckets, self.window = state["ranges"], state["buckets"], window
            self.batches, self.bytes = state["batches"], state["bytes"]
        else:
            self.number, self.runs, self.made, self.window = 0, [], 0, window
            self.batches: dict[str, dict] = {}
            self.bytes = 0
            self.ranges = ranges_for(expected_bytes)
            self.buckets = min(self.ranges, max(shuffle_width(spark), 12))

    def _hadoop(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[int, str]:
        place, fs = self._hadoop(f"{self.path}/manifest")
        if not fs.exists(place):
            return {}
        return {int(s.getPath().getName().removesuffix(".json")): s.getPath().toString() for s in fs.listStatus(place) if s.getPath().getName().endswith(".json")}

    def _commit(self) -> None:
        """The state as a file of its own that appears at once; the one before goes."""
        self.number += 1
        draft, fs = self._hadoop(f"{self.path}/manifest/{self.number}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"window": self.window, "ranges": self.ranges, "buckets": self.buckets, "runs": self.runs, "made": self.made, "batches": self.batches, "bytes": self.bytes}).encode()))
        out.close()
        fs.rename(draft, self._hadoop(f"{self.path}/manifest/{self.number}.json")[0])
        dropped(self.spark, f"{self.path}/manifest/{self.number - 1}.json")

    def _bucketed(self, rows: DataFrame, path: str, by: str, partition_by: tuple[str, ...] = ()) -> None:
        name = f"shelfmark_{uuid.uuid4().hex}"
        writer = rows.write.mode("overwrite").option("compression", "zstd").option("path", path)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with shuffles_dropped(self.spark):
            writer.bucketBy(self.buckets, by).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def _table(self, path: str, columns: str, by: str, partitions: str = "", buckets: int = 0) -> str:
        """A name for bucketed files that are there."""
        name = f"shelfmark_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {partitions} CLUSTERED BY ({by}) INTO {buckets or self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def history(self) -> tuple[str | None, DataFrame | None]:
        """range, hashes of the live runs, read bucket by bucket, and the name of the table, to be dropped when it was read."""
        if not self.runs:
            return None, None
        name = self._table(f"{self.path}/runs", f"{_RUN}, run int", "range", "PARTITIONED BY (run, kind)")
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name, self.spark.table(name).filter(F.col("run").isin(self.runs) & (F.col("kind") == 0)).select("range", "hashes")

    def add(self, docs: DataFrame, key: str | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256, kept of each row of a batch, which joins the index.

        All documents of the index count as earlier than those of the batch; within it order is by doc_id, then start. The
        batch is written in pieces, its hashes merged, and its run committed, when this returns; only the removal itself
        is still to be run, from what is written. Rows as in `deduplicate`. key: the batch's name, by default a digest of its
        rows; a batch of a name that the index has is not read, but answered as before, until it is settled.
        """
        text, number = F.coalesce("text", F.lit("")), F.col("doc_id").cast("bigint")
        rows = docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(NO_ID)).alias("_d"), F.xxhash64(text).alias("_tag"), text.alias("text"))
        mark = F.sum(F.xxhash64("_d", "_tag", F.xxhash64("text", F.lit(5))).cast("decimal(38,0)"))
        size, n, digest = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), mark).first()
        key = key or f"{n} {size} {digest}"
        if key in self.batches:
            return self.answer(key)
        most = min(PIECE_BYTES[1], max(PIECE_BYTES[0], 64 * self.ranges))
        parts = max(1, min(-(-size // most), 4 * self.buckets))
        cut = rows.repartitionByRange(parts, "_d", "_tag").sortWithinPartitions("_d", "_tag").drop("_tag").mapInArrow(tidy(_pieces(most)), _PIECES)
        place = f"{self.path}/batch-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
        self._bucketed(cut, place, "piece")
        name = self._table(place, _PIECES, "piece")
        blocks = self.spark.table(name).groupBy("piece").applyInArrow(blocks_of(self.window, self.ranges), _BLOCKS)
        old_name, old = self.history()
        if old is None:
            rows = blocks.groupBy("range").applyInArrow(_first_batch, _RUN)
        else:
            rows = old.groupBy("range").cogroup(blocks.groupBy("range")).applyInArrow(merged, _RUN)
        self.made += 1
        self._bucketed(rows, f"{self.path}/runs/run={self.made}", "range", ("kind",))
        for table in (name, old_name):
            if table:
                self.spark.sql(f"DROP TABLE {table}")
        self.runs, self.bytes = [*self.runs, self.made], self.bytes + size
        self.batches[key] = {"run": self.made, "place": place, "buckets": self.buckets}
        self._commit()
        return self.answer(key)

    def answer(self, key: str) -> DataFrame:
        """What `add` gave for a batch, from its pieces and what its run tells of them."""
        batch = self.batches[key]
        if batch["place"] is None:
            raise ValueError(f"batch {key!r} is settled: its answer was read, and its pieces are gone")
        told = self.spark.read.schema(_RUN).parquet(f"{self.path}/runs/run={batch['run']}").filter("kind = 1").select("piece", "gone", "first")
        name = self._table(batch["place"], _PIECES, "piece", buckets=batch["buckets"])
        out = self.spark.table(name).groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(stripped(self.window), RESULT)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def settle(self, *keys: str) -> None:
        """Batches (all, if none is named) whose answers have been read for good: their texts and what runs tell of them go."""
        for key in keys or list(self.batches):
            batch = self.batches[key]
            if batch["place"] is not None:
                gone = [batch["place"], f"{self.path}/runs/run={batch['run']}/kind=1"]
                self.batches[key] = batch | {"place": None}
                self._commit()
                dropped(self.spark, *gone)

    def compact(self) -> None:
        """Merge the runs into one when they are more than most_runs; what runs tell of their batches stays. Ranges are split
        if what has come by now asks for more of them."""
        if len(self.runs) <= self.most_runs:
            return
        name, rows = self.history()
        self.made += 1
        self.ranges = max(self.ranges, ranges_for(self.bytes))
        self.buckets = max(self.buckets, min(self.ranges, shuffle_width(self.spark)))
        self._bucketed(rows.groupBy("range").applyInArrow(compacted(self.ranges), _RUN), f"{self.path}/runs/run={self.made}", "range", ("kind",))
        self.spark.sql(f"DROP TABLE {name}")
        old, self.runs = self.runs, [self.made]
        self._commit()
        dropped(self.spark, *[f"{self.path}/runs/run={r}/kind=0" for r in old])


def _first_batch(key: tuple, table: pa.Table) -> pa.Table:
    return merged(key, None, table)


def _pieces(most: int):
    """Rows in order with the number of their piece, which ascends with partitions and rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, texts in slices(batch, 2, most):
                here = sum(map(len, texts))
                if size and size + here > most:
                    piece, size = piece + 1, 0
                size += here
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([piece] * part.num_rows, pa.int64())], names=["doc_id", "_d", "text", "piece"])

    return work


def deduplicate(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, path: str | None = None, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for each row of docs, which join the index in batches by doc_id.

    Every word in a window of `window` words that also starts earlier (smaller doc_id, or same document and earlier start)
    is removed; windows are of the input, not of what is left. Null and empty texts have no words; texts of fewer words
    than a window lose none. Repeated rows have one doc_id and start, so neither is earlier than the other; of several
    texts of one doc_id earlier starts count. A null doc_id comes after all others. An empty table gives no rows. A text of
    any length is a piece by itself, hashed bit by bit. Other columns are not read, so their names may clash with any here.
    On a path where the same rows were added before, all batches are answered as they were then.
    """
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    index = FingerprintIndex(docs.sparkSession, path, window, most_runs, size)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    key, out = F.col("doc_id").cast("bigint"), None
    for i in range(len(cuts) + 1):
        here: Column = F.lit(True)
        if i:
            here = here & (F.coalesce(key > cuts[i - 1], F.lit(True)) if i == len(cuts) else key > cuts[i - 1])
        if i < len(cuts):
            here = here & (key <= cuts[i])
        done = index.add(rows.filter(here))
        index.compact()
        out = done if out is None else out.unionByName(done)
    return out


#: The rule as it is stated; doc_ids are taken to be there and to differ, as the given tables have them.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda s: {'s': s, 'key': md5(array_to_string(w[s:s + 19], ' '))})) AS x FROM d WHERE len(w) >= 20),
ranked AS (SELECT doc_id, x.s AS s, row_number() OVER (PARTITION BY x.key ORDER BY doc_id, x.s) AS r FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
told AS (SELECT x.doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (g.p IS NULL) AS kept FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN told USING (doc_id)
"""
