"""Keyed state with expiry: the stream over restarts equals the ledger at once, and state of skills at rest is gone."""

import json

from shelfmark.schema import HIT_EVENT
from shelfmark.streaming import expiring, ledgers


def test_promotions_expire(spark, tmp_path):
    src, ck, out = tmp_path / "src", str(tmp_path / "ck"), str(tmp_path / "out")
    src.mkdir()

    def file(n, *uses):
        lines = [json.dumps({"ts": f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "kind": kind, "skill": skill}) for skill, m, kind in uses]
        (src / f"{n}.json").write_text("\n".join(lines))

    def run():  # a new query each time: a restart
        query = expiring.promoted(ledgers.hit_stream(spark, str(src), 1), rest=3600, pinned=("pinned",)).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    def state():
        return {r.key["skill"] for r in spark.read.format("statestore").option("stateVarName", "uses").load(ck).select("key").collect()}

    chat = lambda skill, *minutes: [(skill, m, "chat") for m in minutes]
    file(1, *chat("a", 0, 10), *chat("pinned", 0, 1, 2), ("a", 11, "search"), *chat("b", 5))
    run()
    assert state() >= {"a", "b"}
    file(2, *chat("a", 20), *chat("b", 100), ("c", 101, "adopt"))  # a is promoted; b had rested
    run()
    file(3, *chat("b", 110, 120), *chat("d", 300))  # b is promoted in its second round
    run()
    file(4, *chat("d", 301), *chat("a", 302, 303, 304))  # a again, after a rest
    run()
    got = sorted((r.skill, r.uses, str(r.since), str(r.at)) for r in spark.read.parquet(out).collect())
    whole = expiring.promotions(spark.read.schema(HIT_EVENT).json(str(src)), rest=3600, pinned=("pinned",))
    assert got == sorted((r.skill, r.uses, str(r.since), str(r.at)) for r in whole.collect()) and [g[0] for g in got] == ["a", "a", "b"]
    assert not state() & {"b", "c", "pinned"} and state() >= {"d"}
