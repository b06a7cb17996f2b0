"""The mirror of a list: names by turns, and documents that are written only when an item changes."""

import random

from shelfmark.sources import mirror
from shelfmark.sources.store import Store

ITEMS = "name string, description string, body string, ord bigint"


def by_turns(names, safe):
    used, out = set(), []
    for n in names:
        name, i = safe(n), 2
        while name in used:
            name, i = f"{safe(n)}-{i}", i + 1
        used.add(name)
        out.append(name)
    return out


def test_names_by_turns(spark):
    rng = random.Random(8)
    for _ in range(4):
        names = [rng.choice(["a/b", "a:b", "a_b", "a_b-2", "a?b-2", "a_b-3", "a_b-2-2", "c", "c-2", "a_b-4"]) for _ in range(30)]
        items = spark.createDataFrame([(n, None, None, i) for i, n in enumerate(names)], ITEMS)
        got = [r.dirname for r in mirror.assigned(items).orderBy("ord").collect()]
        assert got == by_turns(names, lambda n: n.translate(str.maketrans("/:?", "___")))


def test_only_what_changed_is_written(spark, tmp_path):
    store, body = Store(spark, str(tmp_path / "m")), "A body that is long enough to be kept as it stands here."
    frame = lambda *rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ITEMS)
    told = lambda changes: {r.dirname: r.change for r in changes.collect()}
    one, changes = mirror.mirror(store, frame(("a/b", "first\nline", None), ("a:b", "second", body), ("c", "third", "---\nname: c\n---\n" + body)))
    assert told(changes) == {"a_b": "added", "a_b-2": "added", "c": "added"}
    docs = {r.dirname: r for r in mirror.living(store, one).collect()}
    assert docs["a_b"].stub and mirror.STUB_MARK in docs["a_b"].text and docs["a_b"].text.startswith("---\nname: a/b\ndescription: first line\n---\n")
    assert not docs["a_b-2"].stub and docs["a_b-2"].text.endswith(body) and docs["c"].text == "---\nname: c\n---\n" + body
    same, changes = mirror.mirror(store, frame(("a/b", "first\nline", None), ("a:b", "second", body), ("c", "third", "---\nname: c\n---\n" + body)))
    assert same == one and set(told(changes).values()) == {"kept"}
    two, changes = mirror.mirror(store, frame(("a/b", "first, again", None), ("d", "fourth", None), ("c", "third", "---\nname: c\n---\n" + body)))
    assert told(changes) == {"a_b": "updated", "a_b-2": "removed", "c": "kept", "d": "added"}
    assert spark.read.parquet(two.tables["rows"]["paths"][-1]).count() == 2  # the kept one was not written again
    assert {r.dirname for r in mirror.living(store, two).collect()} == {"a_b", "c", "d"} and mirror.living(store, one).count() == 3
    three, changes = mirror.mirror(store, frame(("a/b", "first, again", None), ("a:b", "second", body), ("c", "third", "---\nname: c\n---\n" + body)))
    assert told(changes) == {"a_b": "kept", "a_b-2": "added", "c": "kept", "d": "removed"} and mirror.living(store, three).count() == 3
