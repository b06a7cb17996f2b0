"""Conversation repair against a brute force over all lists of edits, with conversations cut into segments."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from shelfmark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, CONV_ID2 string, rows string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    """Of one conversation's rows after damage, all that the query returns."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for letter, role in (("u", "user"), ("a", "assistant")):
            if inserted < 3 and (state, letter) in move:
                c, e, t = best(i, move[state, letter], inserted + 1)
                found.append((c + 2, "I" + e, (f"{role}:", *t)))
        if i < len(rows):
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            c, e, t = best(i + 1, state, 0)
            found.append((c + 3, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                for letter, own, cost, edit in ((role[:1], role, 0, "K"), ("u", "user", 2, "R"), ("a", "assistant", 2, "R")):
                    if (state, letter) in move:
                        c, e, t = best(i + 1, move[state, letter], 0)
                        found.append((c + cost + (fault == "truncated"), edit + e, (f"{own}:{text}", *t)))
        return min(found) if found else (1 << 40, "", ())

    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, "", 0)
    numbers = [r[1] for r in rows if r[1] is not None]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def made(seed, convs=60, longest=14):
    rng, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", "Tell me more.", "So it is!", "é.", None, f"Number {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text))
    return rows + rows[:7]


@pytest.mark.parametrize("segment", [3, 20_000])
def test_digests_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = made(segment) + [(99, i, ("user", "assistant")[i % 2], f"Turn {i // 3}.") for i in range(120)]
    got = {r.conv_id: r.asDict() for r in repair.digests(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)).collect()}
    after = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        own = [r for r in after if r[0] == conv]
        assert {k: v for k, v in row.items() if k != "conv_id"} == brute(own), conv


def test_one_conversation_over_all_tasks(spark, monkeypatch):
    """Nearly all rows are one conversation's; repeated texts and repeated rows lie in other tasks than the first."""
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rows = [(1, i, ("user", "assistant", "user", "tool")[i % 4], f"Said {i % 37}{'.' * (i % 3)}") for i in range(400)] + [(2, 0, "user", "Alone.")]
    cut = repair.mended(repair.damaged(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)))[1]
    assert cut.filter("conv_id = 1").count() > 8
    got = {r.conv_id: r.asDict() for r in repair.digests(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    for conv in (1, 2):
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == brute([r for r in damaged(rows) if r[0] == conv])


def test_turns_rebuilt_and_defined_cases(spark):
    turns = spark.createDataFrame([(5, 0, "assistant", "Hello.", "", ""), (5, 1, "user", "Hi", "", ""), (6, 0, "user", "x" * 2_000_000 + ".", "", "")], SCHEMA)
    got = [(r.conv_id, r.role, len(r.text)) for r in repair.repair(turns).orderBy("conv_id", "piece", "place").collect()]
    assert got == [(5, "user", 0), (5, "assistant", 6), (6, "user", 2_000_001), (6, "assistant", 0)]
    assert repair.digests(turns.limit(0)).collect() == []
    # crc32 of 14:0 leaves 0, so all of that conversation is dropped
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.digests(spark.createDataFrame([(lost, 0, "user", "Gone.", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
