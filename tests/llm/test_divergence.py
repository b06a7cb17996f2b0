"""Source divergence against a brute force over all terms and sources."""

import random
import re
from collections import Counter, defaultdict

import pytest

from shelfmark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, VALUE string, term string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s, c in groups.items():
            far = {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in groups if o != s}
            more = {t: p[s][t] - q[t] for t in kept if c[t] and p[s][t] > q[t]}
            for part, values in (("pair", far), ("term", more)):
                for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def made(seed):
    rng = random.Random(seed)
    words = [*"aé bÉ C d ÄB ab abc abcd abcde abcdf über 語 語言".split(), *(f"{a}{b}{c}" for a in "pqr" for b in "pqr" for c in "pqré")]
    rows = [(i, rng.choice([None, "", "1 2", *([" ".join(rng.choices(words, k=12)) + "_Same3same"] * 12)]), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ç", None, "hot", "hot", "hot"])) for i in range(160)]
    return rows + [(900, "only here", "xx", "a"), (901, "", "xx", "b"), (902, None, "yy", None)] + rows[:5]


@pytest.mark.parametrize("few,side", [(1_000, 256), (2, 2)])
def test_against_brute_force(spark, monkeypatch, few, side):
    for name, value in (("LEAST_DOCS", 4), ("FEW", few), ("SIDE", side), ("HELD_BLOCKS", 3), ("HELD_TERMS", 40)):
        monkeypatch.setattr(divergence, name, value)
    rows = made(few)
    got = divergence.audit(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, 4, divergence.TOP)


def test_radix_select_of_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", 2)
    rng = random.Random(1)
    rows = [("en", s, f"{'common/beginning' if rng.random() < 0.7 else 'é'}{i:03d}", rng.choice([1, 5, 5, 5, 1 << 22, (1 << 30) + 7])) for s in ("a", "b") for i in range(60)]
    rows += [("en", "c", "x", 3)]
    got = divergence.first_terms(spark.createDataFrame(rows, "lang string, source string, item string, value long"), 25).collect()
    want = [(lang, s, *x, n) for lang, s in (("en", "a"), ("en", "b"), ("en", "c")) for n, x in enumerate(sorted(((i, v) for _, g, i, v in rows if g == s), key=lambda x: (-x[1], x[0].encode()))[:25], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_shares_beyond_64_bits_and_long_texts(spark):
    rows = [(9_000_000_001, 9_000_000_100), (10**13, 3 * 10**13 + 1), (0, 10**14), (7, 9)]
    got = spark.createDataFrame(rows, "c long, t long").select(divergence.share("c", "t").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // t for c, t in rows]
    text = ("Wörd x" * 300_000 + " tail").encode()
    assert sum(len(divergence.TERM.findall(p)) for p in divergence.pieces(text)) == len(divergence.TERM.findall(text.lower()))
    long = b"A" * 3_000_000 + b" b"
    assert [len(t) for p in divergence.pieces(long) for t in divergence.TERM.findall(p)] == [3_000_000, 1]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
