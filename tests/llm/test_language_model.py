"""The language model: base scores against brute force, seats against exact odds, probabilities that sum to one, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import language_model as lm
from shelfmark.llm import seating

SCHEMA = "doc_id long, text string, SCORE string, words string"


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def made(n=240):
    rng = random.Random(3)
    follows = {w: rng.sample([f"w{i}" for i in range(60)], 4) for w in (f"w{i}" for i in range(60))}
    rows = []
    for i in range(n):
        word, text = f"w{rng.randrange(60)}", []
        for _ in range(rng.randrange(1, 40)):
            text.append(word.upper() if rng.random() < 0.1 else word)
            word = rng.choice(follows[word])
        rows.append((i, (" " * rng.randrange(1, 3)).join(text)))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (None, "w1 w2"), (1003, "unheard of é語 w1"), (1004, "w1 " * 30_000)] + rows[:4]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).sortWithinPartitions("doc_id")


@pytest.fixture(scope="module")
def scored(spark):
    return sorted((tuple(r) for r in lm.scores(frame(spark, made())).collect()), key=repr)


def test_base_against_brute_force(scored):
    rows = made()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows), key=repr)
    got = sorted((r[:6] for r in scored), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_scores_are_log_probabilities_that_beat_the_base(scored):
    assert all(r[6] < 0 for r in scored)
    own = [r for r in scored if r[1]]
    assert sum(r[6] for r in own) > 0.7 * sum(r[5] for r in own)
    by = {}
    for r in scored:
        by.setdefault(r[0], set()).add(r[5:])
    assert all(len(x) == 1 for x in by.values())  # repeated rows score alike


def test_hot_contexts_and_many_parts_change_no_counts(spark, scored, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 20)
    monkeypatch.setattr(lm, "BLOCK_TEXTS", 7)
    found = lm.hot_contexts(frame(spark, made()).selectExpr("coalesce(text, '') as text", "doc_id", "true as teaches"))
    assert 0 < len(found) <= 40
    got = sorted((tuple(r) for r in lm.scores(frame(spark, made())).collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in scored]
    np.testing.assert_allclose([r[6] for r in got], [r[6] for r in scored], rtol=0.15)


def test_probabilities_after_a_context_sum_to_one(spark):
    """Over all known words and one for the unknown, from the learnt state, for every context."""
    rows = frame(spark, made()).selectExpr("coalesce(text, '') as text", "doc_id", "true as teaches")
    model = lm.Model(rows)
    m, parents = model.totals[lm.ROUNDS], {}
    last = model.told.filter(f"round = {lm.ROUNDS}")
    for part in model.parts.toArrow().to_pylist():
        told = last.filter(f"part = {part['part']}").toArrow().to_pylist()
        x = lm._Part(part, [r for r in told if r["share"] >= 0], model.hot)
        parents |= dict(zip(x.known.tolist(), np.where(x.numbers[0] > 0, x.parent(m), 0).tolist()))
    unknown = (lm.STRENGTH + m["d1"] * m["T"]) / (m["V"] + 1) / (lm.STRENGTH + m["C"])
    assert abs(sum(parents.values()) + unknown - 1) < 1e-9
    for part in model.parts.toArrow().to_pylist():
        told = last.filter(f"part = {part['part']}").toArrow().to_pylist()
        x = lm._Part(part, [r for r in told if r["share"] >= 0], model.hot)
        tables = np.frombuffer(next(r for r in told if r["share"] == -1)["tables"], "<u4").astype(np.int64)
        p, parent = x.predictive(tables, m), x.parent(m)[x.w]
        spare = (lm.STRENGTH + m["d2"] * x.of_contexts(tables, 4)) / (lm.STRENGTH + x.of_contexts(x.c, 3))
        whole = ~np.isin(x.contexts, model.hot)  # all of their pairs are in this part
        sums = np.add.reduceat(p, x.first) + spare * (1 - np.add.reduceat(parent, x.first))
        np.testing.assert_allclose(sums[whole], 1, rtol=1e-9)


@pytest.mark.parametrize("c,weight", [(2, 0.3), (5, 0.3), (5, 2.0), (9, 1.0)])
def test_seats_keep_their_exact_odds(c, weight):
    """After many sweeps the number of tables of a dish follows weight**t times the generalised Stirling numbers."""
    d, n, rng = 0.6, 6_000, np.random.default_rng(5)
    stirling = {1: 1.0}
    for k in range(1, c):
        stirling = {t: stirling.get(t - 1, 0) + (k - d * t) * stirling.get(t, 0) for t in range(1, k + 2)}
    odds = np.array([stirling.get(t, 0) * weight**t for t in range(1, c + 1)])
    counts, state = np.full(n, c), None
    for _ in range(12):
        tables, state = seating.seated(counts, np.full(n, weight), d, state, rng)
    assert (np.add.reduceat(state[1], np.r_[0, np.cumsum(state[0].astype(np.int64))[:-1]]) == c).all()
    np.testing.assert_allclose(np.bincount(tables, minlength=c + 1)[1:] / n, odds / odds.sum(), atol=0.03)


def test_large_and_single_dishes():
    c = np.array([0, 1, 1, 10**12, 3, 5_000])
    tables, (t, sizes) = seating.seated(c, np.full(6, 0.5), 0.7, None, np.random.default_rng(1))
    assert tables[:3].tolist() == [0, 1, 1] and (1 <= tables[3:]).all() and (tables <= np.maximum(c, 0)).all()
    assert len(t) == 1 and sizes.sum() == 3


def test_nothing_to_learn_from_and_empty_table(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert [tuple(r) for r in lm.scores(frame(spark, [(held, "some words")])).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert lm.scores(frame(spark, [(held, "x")]).limit(0)).collect() == []


def test_pairs_are_counted_once_even_where_hashes_nearly_meet():
    """Hashes that differ in their lowest bits alone may come in several runs; merged parts name each pair once, in order."""
    keys = np.array([8, 9, 8, 1 << 60, 9, 8, 1 << 60], np.uint64)
    order = lm.together(keys)
    assert sorted(order.tolist()) == list(range(7)) and order.tolist()[-2:] == [3, 6]
    assert [i for i in order.tolist() if keys[i] == 8] == [0, 2, 5] and lm.together(keys[:0]).tolist() == []
    rng = np.random.default_rng(2)
    v, w = rng.integers(0, 9, 3_000).astype(np.uint64), rng.integers(0, 40, 3_000).astype(np.uint64)
    rows = pa.table({"runs": [np.ones(3_000, "<u4").tobytes()], "contexts": [v.tobytes()], "words": [w.tobytes()], "counts": [np.ones(3_000, "<u4").tobytes()]})
    row = lm._merged(np.array([3], np.uint64))((pa.scalar(0),), rows).to_pylist()[0]
    known, runs = lm.opened(row["known"], "<u8"), lm.opened(row["runs"], "<u4")
    got = list(zip(np.repeat(lm.opened(row["contexts"], "<u8"), runs).tolist(), known[lm.opened(row["words"], "<u4")].tolist()))
    assert dict(zip(got, lm.opened(row["counts"], "<u8").tolist())) == Counter(zip(v.tolist(), w.tolist())) and got == sorted(set(got))


def test_rounds_send_numbers_in_as_few_bytes_as_they_need_and_keep_no_seats():
    rng = np.random.default_rng(4)
    v, w = np.repeat(np.arange(90, dtype=np.uint64), 40), rng.integers(0, 900, 3_600).astype(np.uint64)
    rows = pa.table({"runs": [np.ones(3_600, "<u4").tobytes()], "contexts": [v.tobytes()], "words": [w.tobytes()], "counts": [np.ones(3_600, "<u4").tobytes()]})
    part, none = lm._merged(np.empty(0, np.uint64))((pa.scalar(0),), rows), lm._SENT.empty_table()
    known = len(np.unique(w))
    sent = lm._sampled(np.empty(0, np.uint64), 1, 0, None)((pa.scalar(0),), part, none).to_pylist()
    assert sum(len(r["numbers"] or b"") for r in sent) <= 8 + 4 * known
    answers = [r for b in lm._answered(0, None)((pa.scalar(0),), iter(pa.Table.from_pylist(sent[1:], lm._SENT).to_batches())) for r in b.to_pylist()]
    assert len(answers[0]["numbers"]) <= 8 + 5 * known
    x = lm._Part(part.to_pylist()[0], answers[:1], np.empty(0, np.uint64))
    assert x.numbers[0].tolist() == np.unique(w, return_counts=True)[1].tolist()
    assert set(sent[0]) <= {"part", "share", "words", "numbers", "tables"} and len(sent[0]["tables"]) == 4 * len(x.c)


@pytest.mark.parametrize("most", [0, 1, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**62])
def test_narrow_numbers_come_back(most):
    x = np.array([0, most // 2, most])
    assert lm.widened(lm.narrow(x)).tolist() == x.tolist() and lm.widened(lm.narrow(x[:0])).tolist() == []


def test_hot_contexts_that_share_a_slot_are_told_apart():
    hot = np.sort(np.array([5, 5 + (1 << 18), 5 + (1 << 40), 77, (1 << 63) + 77], np.uint64))
    v = np.r_[hot, hot + np.uint64(1 << 30), np.arange(300, dtype=np.uint64)]
    assert lm.among(v, hot).tolist() == np.isin(v, hot).tolist() and not lm.among(v, hot[:0]).any()


def test_pieces_change_no_hash_of_a_word(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("xyz"[i % 3] * rng.choice([1, 3, 70, 400]) for i in range(rng.randrange(60))).encode() for _ in range(50)] + [b"", b"  ", b"a" * 70_000]
    whole = lm.sequences(texts)
    for size in (64, 1_000, 1 << 20):
        monkeypatch.setitem(lm.Words.__init__.__globals__, "PIECE_BYTES", size)
        for a, b in zip(whole, lm.sequences(texts)):
            assert a.tolist() == b.tolist()
