"""A hierarchical Pitman-Yor model of words after words, and what it says of each text.

Every word (and the start of a text) is a context with a restaurant; the dishes are the words after it. All restaurants share
a parent, that of words alone, whose parent is uniform over the known words and one for all others. Seats are sampled by
blocked Gibbs (seating.py) in ROUNDS rounds: each moves all customers of a dish at once, by the exact odds of its number of
tables. Tables of the contexts are customers of the parent. A word's probability is the mean of its predictive probabilities
over the rounds after the first BURN_IN.

The work is dealt by contexts, those with a large share of all tokens by context and word, so that no part holds a hot one. A
part is a row of packed arrays. In each round a part sends for each of its words the tables it has, and shares of the parent
answer with the sums; nothing but totals passes the driver. Texts are read again to be scored: a block of texts asks the parts
for its distinct pairs, with the texts they are in, and gets sums for each text. Words are told by 64-bit hashes, pairs within
a part by 64 more bits: at n distinct words some n * n / 2**65 are taken for others, which moves their counts and nothing else.

Defined cases: a null text is empty and has the end alone; a null doc_id teaches; repeated rows teach and are scored each; a
text of any length is tokenised in pieces, but it is a block of its own with some 100 bytes a word; other columns are
ignored, however named; an empty table gives no rows. Without any text to learn from all probabilities are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bucketed, dropped, release_worker_memory, scratch_dir, shuffle_width, slices, tidy, unbucketed, whole_text, written
from shelfmark.llm.hashing import NOT_SPACE, Words, mix
from shelfmark.llm.seating import drawn

ROUNDS, BURN_IN = 3, 1
STRENGTH = 1.0
HOT = 1_000  # a context of more than one in so many tokens is dealt by its words
BLOCK_BYTES, BLOCK_TEXTS = 8 << 20, 60_000
PARTS = 3  # times the partitions of a shuffle, so that a task holds little at once
PARTS_PER_SHARE = 8  # parts for each share of the parent, as every part sends to every share
PASSES = 2  # over the texts to score them, so that what a pass shuffles stays below the texts' own size

TOKENS = bytes(c + 32 if 65 <= c <= 90 else NOT_SPACE[c] for c in range(256))
START, END = (int(x) for x in mix(np.array([0x5354415254, 0x454E44], np.uint64)))
PAIR = np.uint64(0xD6E8FEB86659FD93)
SEED = 7
SLOTS = np.uint64((1 << 18) - 1)  # of hot contexts, of which there are far fewer


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 by 7: such rows never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * PAIR + w)


def part_of(x: np.ndarray, n: int) -> np.ndarray:
    """One of n equal ranges of 64-bit hashes."""
    return ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def among(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which are hot: each has a slot by its last bits, and the few that share one are compared by themselves."""
    if not len(hot):
        return np.zeros(len(v), bool)
    slot = (hot & SLOTS).astype(np.int64)
    place = np.zeros(int(SLOTS) + 1, np.uint16)
    place[slot] = np.arange(len(hot))
    out = hot[place[(v & SLOTS).astype(np.int64)]] == v
    for x in hot[place[slot] != np.arange(len(hot))]:
        out |= v == x
    return out


def dealt(v: np.ndarray, key: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The part of each pair, from its context and the hash of both: by context, or by both where the context is hot."""
    return part_of(np.where(among(v, hot), key, v) if len(hot) else v, n)


def sorted_parts(parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, and where each part begins in it."""
    parts = parts.astype(np.uint16 if n < 1 << 16 else np.uint32)  # short numbers sort faster
    by = np.argsort(parts, kind="stable")
    return by, np.searchsorted(parts[by], np.arange(n + 1))


def packed(x: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


def opened(x, dtype: str) -> np.ndarray:
    return np.frombuffer(x.as_py() if hasattr(x, "as_py") else x, dtype)


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, after eight bytes that say how many."""
    size = next(b for b in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * b - (b == 8))
    return packed(np.array([size]), "<i8") + packed(x, f"<u{size}")


def widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{int(np.frombuffer(x, '<i8', 1)[0])}", offset=8)


def joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(x, dtype) for x in column.to_pylist())])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list, np.ndarray]]:
    """Texts, doc_ids and which teach, of about BLOCK_BYTES of texts."""
    texts: list[bytes] = []
    ids: list = []
    teach: list[bool] = []
    size = 0
    for batch in batches:
        for part, found in slices(batch, 0):
            texts += found
            ids += part.column(1).to_pylist()
            teach += part.column(2).to_pylist()
            size += sum(map(len, found))
            if size >= BLOCK_BYTES or len(texts) >= BLOCK_TEXTS:
                yield texts, ids, np.array(teach)
                texts, ids, teach, size = [], [], [], 0
    if texts:
        yield texts, ids, np.array(teach)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the texts, ends included: the hash of the one before, its own, and the number of its text."""
    words = Words(texts, TOKENS)
    lengths, n = words.last - words.first, len(texts)
    at = np.arange(len(words.hashes)) + np.repeat(np.arange(n), lengths)
    before, own = np.empty(len(at) + n, np.uint64), np.full(len(at) + n, np.uint64(END))
    before[words.first + np.arange(n)] = np.uint64(START)
    before[at + 1] = words.hashes
    own[at] = words.hashes
    return before, own, np.repeat(np.arange(n), lengths + 1)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each block with half of a hot one's share, and the number of tokens (without a word)."""
    for texts, _, _ in blocks(batches):
        before = np.r_[Words(texts, TOKENS).hashes, np.full(len(texts), np.uint64(START))]  # something follows each of these
        words, n = np.unique(before, return_counts=True)
        many = n * 2 * HOT > len(before)
        yield pa.RecordBatch.from_arrays([pa.array([*words[many].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[many].tolist(), len(before)], pa.int64())], ["word", "n"])


def hot_contexts(rows: DataFrame) -> np.ndarray:
    """All contexts with more than one in HOT of the tokens, and at most 2 * HOT in all: each is frequent enough in some block."""
    place = scratch_dir(rows.sparkSession)
    found = written(rows.mapInArrow(tidy(_frequent), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), place)
    total = found.filter("word is null").agg(F.max("n")).first()[0] or 0
    hot = found.filter("word is not null").filter(F.col("n") * 2 * HOT >= total).select("word").toArrow()["word"].to_numpy()
    dropped(rows.sparkSession, place)
    return np.sort(hot.astype(np.int64).view(np.uint64))


def together(keys: np.ndarray) -> np.ndarray:
    """An order that brings equal 64-bit hashes together, each in order of place.

    Places are sorted along in the low bits, which is several times as fast as sorting places by keys. Two hashes that are equal
    in all other bits may take turns, so what is the same may come in several runs.
    """
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    return (order & low).astype(np.int64)


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    other = np.zeros(len(columns[0]), bool)
    other[:1] = True
    for x in columns:
        other[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(other)


def distinct(before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the tokens by pair, where a run of a pair begins in it, and the pairs; seldom a pair has several runs."""
    order = together(pair(before, own))
    v, w = before[order], own[order]
    begins = runs_of(v, w)
    return order, begins, v[begins], w[begins]


def _counted(hot: np.ndarray, n: int):
    """Pairs of each block with how often they teach, by part: contexts, how many pairs each has, words, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _, teach in blocks(batches):
            before, own, doc = sequences(texts)
            order, begins, v, w = distinct(before, own)
            c = np.add.reduceat(teach[doc[order]].astype(np.int64), begins)
            by = together(v)
            v, w, c = v[by], w[by], c[by]
            by, cuts = sorted_parts(dealt(v, pair(v, w), hot, n), n)
            v, w, c = v[by], w[by], c[by].astype("<u4")
            out = []
            for p in range(n):
                rows = slice(cuts[p], cuts[p + 1])
                if cuts[p + 1] > cuts[p]:
                    first = runs_of(v[rows])
                    out.append({"part": p, "contexts": packed(v[rows][first], "<u8"), "runs": packed(np.diff(np.r_[first, cuts[p + 1] - cuts[p]]), "<u4"), "words": packed(w[rows], "<u8"), "counts": packed(c[rows], "<u4")})
            yield pa.RecordBatch.from_pylist(out, _COUNTED)

    return tidy(run)


_COUNTED = pa.schema([("part", pa.int64()), ("contexts", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_PART = pa.schema([*_COUNTED, ("known", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64())])
_SENT = pa.schema([("part", pa.int64()), ("share", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary()), ("tables", pa.binary())])
_ANSWER = pa.schema([("part", pa.int64()), ("share", pa.int64()), ("numbers", pa.binary()), ("totals", pa.list_(pa.int64()))])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def nothing(spark: SparkSession, columns: str) -> DataFrame:
    """An empty table, without tasks that make it."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in columns.split(", "))])


def _merged(hot: np.ndarray):
    """One part's pairs, in order of context and word; words are numbers into `known`, the part's words and hot contexts."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        release_worker_memory()
        runs = joined(rows["runs"], "<u4")
        w, c = joined(rows["words"], "<u8"), joined(rows["counts"], "<u4").astype(np.int64)
        contexts, of_context = np.unique(joined(rows["contexts"], "<u8"), return_inverse=True)
        of_context = np.repeat(of_context, runs)
        known, of_word = np.unique(np.r_[w, contexts[np.isin(contexts, hot)]], return_inverse=True)
        place = of_context * len(known) + of_word[: len(w)]
        order = np.argsort(place)
        first = runs_of(place[order])
        place, c = place[order][first], np.add.reduceat(c[order], first)
        row = {"part": key[0].as_py(), "contexts": packed(contexts, "<u8"), "runs": packed(np.bincount(place // len(known), minlength=len(contexts)), "<u4"), "words": packed(place % len(known), "<u4"), "counts": packed(c, "<u8"), "known": packed(known, "<u8"), "ones": int((c == 1).sum()), "twos": int((c == 2).sum())}
        return pa.Table.from_pylist([row], _PART)

    return run


class _Part:
    """A part with what the parent's shares answered for its words: customers, tables and counts, of all parts."""

    def __init__(self, row: dict, answers: list[dict], hot: np.ndarray) -> None:
        self.contexts, self.runs = opened(row["contexts"], "<u8"), opened(row["runs"], "<u4").astype(np.int64)
        self.w, self.c, self.known = opened(row["words"], "<u4"), opened(row["counts"], "<u8").astype(np.int64), opened(row["known"], "<u8")
        self.context = np.repeat(np.arange(len(self.contexts)), self.runs)
        self.first = np.cumsum(self.runs) - self.runs
        self.hot = np.flatnonzero(np.isin(self.contexts, hot))
        self.hot_at = np.searchsorted(self.known, self.contexts[self.hot])
        told = [widened(a["numbers"]).reshape(5, -1).astype(np.int64) for a in sorted(answers, key=lambda a: a["share"])]
        #: of each known word: count, customers and tables at the parent, count and tables as a hot context
        self.numbers = np.concatenate(told, axis=1) if told else None

    def of_contexts(self, x: np.ndarray, hot: int) -> np.ndarray:
        """Sums of a number of pairs over each context; of hot ones, over all parts."""
        out = np.add.reduceat(x, self.first)
        if self.numbers is not None:
            out[self.hot] = self.numbers[hot][self.hot_at]
        return out

    def parent(self, m: dict) -> np.ndarray:
        """Probability of each known word in the parent."""
        _, customers, tables, _, _ = self.numbers
        return (customers - m["d1"] * tables + (STRENGTH + m["d1"] * m["T"]) / (m["V"] + 1)) / (STRENGTH + m["C"])

    def predictive(self, tables: np.ndarray, m: dict) -> np.ndarray:
        """Probability of each pair's word after its context, from a sample of tables."""
        own, every = self.of_contexts(tables, 4), self.of_contexts(self.c, 3)
        spare = (STRENGTH + m["d2"] * own)[self.context] * self.parent(m)[self.w]
        return (self.c - m["d2"] * tables + spare) / (STRENGTH + every[self.context])


def _stated(rows: list[dict]) -> tuple[dict | None, list[dict]]:
    """The part's state, and answers of all shares."""
    return next((r for r in rows if r["share"] < 0), None), [r for r in rows if r["share"] >= 0]


def _sampled(hot: np.ndarray, shares: int, number: int, m: dict | None):
    """A round of one part: its tables, and for each share of the parent its words' tables."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table, told: pa.Table) -> pa.Table:
        release_worker_memory()
        state, answers = _stated(told.to_pylist())
        x = _Part(part.to_pylist()[0], answers, hot)
        rng = np.random.default_rng([SEED, number, key[0].as_py()])
        if m is None:
            tables = (x.c > 0).astype(np.int64)
        else:
            tables = opened(state["tables"], "<u4").astype(np.int64)
            spare = STRENGTH + m["d2"] * x.of_contexts(tables, 4)
            tables, several = (x.c > 0).astype(np.int64), np.flatnonzero(x.c > 1)
            tables[several] = drawn(x.c[several], spare[x.context[several]] * x.parent(m)[x.w[several]], m["d2"], rng)
        out = [{"part": key[0].as_py(), "share": -1, "tables": packed(tables, "<u4")}]
        size = len(x.known)
        numbers = np.zeros((4, size), np.int64)  # count and tables as a word; as a hot context
        numbers[0], numbers[1] = np.bincount(x.w, x.c, size), np.bincount(x.w, tables, size)
        for i, values in ((2, x.c), (3, tables)):
            numbers[i][x.hot_at] = np.add.reduceat(values, x.first)[x.hot]
        cuts = np.searchsorted(part_of(x.known, shares), np.arange(shares + 1, dtype=np.uint64))
        for s in range(shares):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if b > a:
                out.append({"part": key[0].as_py(), "share": s, "words": packed(x.known[a:b], "<u8"), "numbers": narrow(numbers[:, a:b])})
        return pa.Table.from_pylist(out, _SENT)

    return run


def _answered(number: int, m: dict | None):
    """A share of the parent: its words' customers are seated, and each part gets the numbers of the words it sent."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_memory()
        parts, words, given = [], [], []
        for batch in batches:
            for r in batch.select(["part", "words", "numbers"]).to_pylist():
                parts.append(r["part"])
                words.append(opened(r["words"], "<u8"))
                given.append(widened(r["numbers"]).reshape(4, -1))
        ends = np.cumsum([len(w) for w in words])
        words, at = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.zeros((4, len(words)), np.int64)
        for b, numbers in zip(ends, given):
            sums[:, at[b - numbers.shape[1] : b]] += numbers  # a part names a word once
        del given
        count, customers, as_context, open_tables = sums
        if m is None:
            tables = (customers > 0).astype(np.int64)
        else:
            rng = np.random.default_rng([SEED, number, 1 << 32, key[0].as_py()])
            weight = np.full(len(words), (STRENGTH + m["d1"] * m["T"]) / (m["V"] + 1))
            tables = drawn(customers, weight, m["d1"], rng)
        every = np.stack([count, customers, tables, as_context, open_tables])
        for part, a, b in zip(parts, [0, *ends[:-1]], ends):
            yield pa.RecordBatch.from_pylist([{"part": part, "share": key[0].as_py(), "numbers": narrow(every[:, at[a:b]])}], _ANSWER)
        totals = [int((count > 0).sum()), int(count.sum()), int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum())]
        yield pa.RecordBatch.from_pylist([{"part": -1, "share": key[0].as_py(), "totals": totals}], _ANSWER)

    return run


def discount(ones: int, twos: int) -> float:
    """The usual estimate from how many are there once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class Model:
    """Learnt parts in the shared folder: `parts` (pairs) and `told` (tables, and the parent's numbers, of each round that counts).

    n, hot: how pairs are dealt; totals: of each round that counts.
    """

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        self.n = PARTS * shuffle_width(spark)
        self.hot = hot_contexts(rows)
        self.parts, self.name = bucketed(rows.mapInArrow(_counted(self.hot, self.n), ddl(_COUNTED)).groupBy("part").applyInArrow(_merged(self.hot), ddl(_PART)), "part", shuffle_width(spark))
        ones, twos = self.parts.agg(F.sum("ones"), F.sum("twos")).first()
        m, old, told = None, [], nothing(spark, ddl(_SENT))
        self.totals: dict[int, dict] = {}
        self.told = nothing(spark, f"round int, {ddl(_SENT)}")
        for number in range(ROUNDS + 1):
            sent_at, state_at, answers_at = (scratch_dir(spark) for _ in range(3))
            sent = written(self.parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_sampled(self.hot, max(1, self.n // PARTS_PER_SHARE), number, m), ddl(_SENT)), sent_at)
            answers = written(sent.filter("share >= 0").select("part", "share", "words", "numbers").groupBy("share").applyInArrow(_answered(number, m), ddl(_ANSWER)), answers_at)
            state = written(sent.filter("share < 0").select("part", "share", "tables"), state_at)
            sums = answers.filter("part < 0").select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
            v, total, customers, tables, ones1, twos1 = [x.n for x in sorted(sums)] or [0] * 6
            m = {"V": v, "N": total, "C": customers, "T": tables, "d2": discount(ones or 0, twos or 0), "d1": m["d1"] if m else discount(ones1, twos1)}
            told = state.unionByName(answers.filter("part >= 0").select("part", "share", "numbers"), allowMissingColumns=True)
            dropped(spark, sent_at, *old)
            old = [state_at, answers_at]
            if number > BURN_IN:
                old, self.totals[number] = [], m
                self.told = self.told.unionByName(told.withColumn("round", F.lit(number)), allowMissingColumns=True)


def _asked(hot: np.ndarray, n: int, turn: int):
    """Each block's pairs, by part: their hashes, how many texts each is in, those texts and how often; and a row for the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for texts, ids, teach in blocks(batches):
            before, own, doc = sequences(texts)
            key = pair(before, own)
            to = dealt(before, key, hot, n)
            if turn == 0:
                head = pa.RecordBatch.from_pylist([{"part": number % n, "block": number, "ids": [None if i is None else str(i) for i in ids], "head": packed(np.stack([np.bincount(doc, minlength=len(texts)), ~teach]), "<i8")}], _ASKED)
                yield head
            asking = np.flatnonzero(to % np.uint64(PASSES) == np.uint64(turn))
            order, cuts = sorted_parts(to[asking], n)
            order = asking[order]
            every_key, every_text = key[order], doc[order]
            for p in range(turn, n, PASSES):
                rows = slice(cuts[p], cuts[p + 1])
                if cuts[p + 1] > cuts[p]:
                    key, text = every_key[rows], every_text[rows]
                    by = together(key)  # texts ascend within a run of a key
                    key, text = key[by], text[by]
                    cells = runs_of(key, text)
                    heads = runs_of(key[cells])
                    yield pa.RecordBatch.from_pylist([{"part": p, "block": number, "keys": packed(key[cells][heads], "<u8"), "runs": narrow(np.diff(np.r_[heads, len(cells)])), "texts": narrow(text[cells]), "times": narrow(np.diff(np.r_[cells, len(key)]))}], _ASKED)
            number += 1

    return tidy(run)


_ASKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary()), ("texts", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(pa.string())), ("head", pa.binary())])
_SUMS = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.string())), ("head", pa.binary()), ("texts", pa.binary()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary())])


def _scored(hot: np.ndarray, totals: dict[int, dict]):
    """Of each block that asks, its texts' sums over the part's pairs; rows for the blocks themselves go on as they are."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table, told: pa.Table) -> pa.Table:
        release_worker_memory()
        rows = told.to_pylist()
        del told
        out = [{n: r[n] for n in ("block", "part", "ids", "head")} for r in rows if r["ids"] is not None]
        asked = [r for r in rows if r["keys"] is not None]
        if asked:
            p = 0.0
            for number, m in totals.items():
                state, answers = _stated([r for r in rows if r["round"] == number])
                x = _Part(part.to_pylist()[0], answers, hot)
                p = p + x.predictive(opened(state["tables"], "<u4").astype(np.int64), m) / len(totals)
            score, count = np.log10(p), x.numbers[0][x.w]
            del p, state, answers
            base = np.log10((count + 1) / (m["N"] + m["V"] + 1))
            keys = pair(x.contexts[x.context], x.known[x.w])
            order = np.argsort(keys)
            keys = keys[order]
            for r in asked:
                at = np.repeat(order[np.searchsorted(keys, opened(r["keys"], "<u8"))], widened(r["runs"]))
                doc = widened(r["texts"])
                times = widened(r["times"]).astype(np.float64)
                texts = np.flatnonzero(np.bincount(doc))
                sums = [np.bincount(doc, v[at] * times)[texts] for v in (score, base, count > 0)]
                out.append({"block": r["block"], "part": key[0].as_py(), "texts": packed(texts, "<u4"), "score": packed(sums[0], "<f8"), "base": packed(sums[1], "<f8"), "known": packed(sums[2], "<u4")})
        return pa.Table.from_pylist(out, _SUMS)

    return run


_RESULT = pa.schema([("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _totalled(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The texts of a block: sums over all parts, in their order, so that equal texts get equal sums."""
    found = rows.to_pylist()
    head = next(r for r in found if r["ids"] is not None)
    n_tokens, held = opened(head["head"], "<i8").reshape(2, -1)
    score, base, known = np.zeros(len(held)), np.zeros(len(held)), np.zeros(len(held), np.int64)
    for r in sorted((r for r in found if r["ids"] is None), key=lambda r: r["part"]):
        at = opened(r["texts"], "<u4")
        score[at] += opened(r["score"], "<f8")
        base[at] += opened(r["base"], "<f8")
        known[at] += opened(r["known"], "<u4")
    return pa.Table.from_arrays([pa.array(head["ids"], pa.string()), pa.array(held == 1), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score)], schema=_RESULT)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; the model learns from rows that aren't held out.

    docs is read a few times and must give the same rows in the same order, as a table does.
    """
    rows = docs.select(whole_text().alias("text"), "doc_id", (~held_out(F.col("doc_id"))).alias("teaches"))
    model = Model(rows)
    found = None
    for turn in range(PASSES):
        own = F.col("part") % PASSES == turn  # no block asks another part in this pass
        asked = rows.mapInArrow(_asked(model.hot, model.n, turn), ddl(_ASKED)).unionByName(model.told.filter(own), allowMissingColumns=True)
        sums = written(model.parts.filter(own).groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_scored(model.hot, model.totals), ddl(_SUMS)))
        found = sums if found is None else found.unionByName(sums)
    unbucketed(docs.sparkSession, model.name)
    out = found.groupBy("block").applyInArrow(_totalled, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    kind = docs.schema["doc_id"].dataType
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.totals[ROUNDS]["N"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, base, model: perplexities of the texts that taught and of those that didn't."""
    tokens = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(tokens.alias("tokens"), F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base"), F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("model"))
