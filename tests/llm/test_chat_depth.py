"""Long chains of calls, levels in a row against rounds, and schemas of any depth."""

import json
import random
import time

import pytest

from shelfmark.llm import chat

RESULTS = "conv_id bigint, call_id string, content string, place bigint"


def levels(frame, **options):
    return {(r.conv_id, r.call_id): r.level for r in chat._levels(frame, **options).collect()}


def calls(spark, rows):
    return spark.createDataFrame([(c, i, "get", "{}", after, p) for c, i, after, p in rows], chat.CALLS)


def test_levels_in_a_row_and_by_rounds(spark):
    """Chains, cycles, what waits behind a cycle, and free calls, against a walk over each conversation."""
    rng, rows = random.Random(3), []
    for conv in range(25):
        for n in range(rng.randrange(1, 9)):
            rows.append((conv, f"c{n}", [f"c{rng.randrange(9)}" for _ in range(rng.randrange(3))], n))

    def brute(conv, call, seen=()):
        if call in seen:
            return -1
        own = next(a for c, i, a, _ in rows if (c, i) == (conv, call))
        found = [brute(conv, d, (*seen, call)) for d in own if d != call and any((c, i) == (conv, d) for c, i, _, _ in rows)]
        return -1 if -1 in found else max(found, default=-1) + 1

    frame = calls(spark, rows)
    near, far = levels(frame), levels(frame, in_row=2)
    assert near == far == {k: brute(*k) for k in near} and -1 in near.values() and max(near.values()) > 1


def test_a_chain_of_a_thousand_calls(spark):
    """Each call waits for the one after it, so all are turned round."""
    rows = [(1, f"c{n}", [f"c{n + 1}"], n) for n in range(1000)]
    began = time.time()
    got = chat.link(calls(spark, rows), spark.createDataFrame([], RESULTS), spark.createDataFrame([("get", "{}")], "name string, schema string")).first()
    took = time.time() - began
    assert [m["call_id"] for m in json.loads(got.messages)] == [f"c{n}" for n in reversed(range(1000))]
    assert got.n_cyclic == 0 and took < 60


def fault(spark, schema, value):
    frame = spark.createDataFrame([(1, "a", "get", json.dumps(value), [], 0)], chat.CALLS)
    return chat.checked(frame, spark.createDataFrame([("get", json.dumps(schema))], "name string, schema string")).first().fault


def nested(depth, leaf):
    return leaf if depth == 0 else {"type": "object", "properties": {"x": nested(depth - 1, leaf)}}


def test_schemas_of_any_depth(spark):
    for depth in (1, 5, 12):
        value = lambda x: {"x": x} if depth == 1 else json.loads('{"x":' * depth + json.dumps(x) + "}" * depth)
        schema = nested(depth, {"type": "integer"})
        assert fault(spark, schema, value(3)) is None and fault(spark, schema, value("three")) == "type"
    lists = {"type": "object", "properties": {"x": {"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"enum": [1, 2]}}}}}}
    assert fault(spark, lists, {"x": [[[1], [2, 2]]]}) is None and fault(spark, lists, {"x": [[[1], [2, 3]]]}) == "value"


@pytest.mark.parametrize("keyword,right,wrong", [
    ({"pattern": "^a+$"}, "aaa", "ab"), ({"const": 7}, 7, 8), ({"minItems": 2}, [1, 2], [1]), ({"maxItems": 1}, [], [1, 2]), ({"title": "x", "maxLength": 2}, "ab", "abc")])
def test_keywords(spark, keyword, right, wrong):
    schema = {"type": "object", "properties": {"x": keyword}}
    assert fault(spark, schema, {"x": right}) is None and fault(spark, schema, {"x": wrong}) == "value"


@pytest.mark.parametrize("keyword", [{"anyOf": []}, {"$ref": "#/x"}, {"format": "date"}, {"additionalProperties": {"type": "string"}}])
def test_what_is_not_checked_is_told(spark, keyword):
    schema = {"type": "object", "required": ["x"], "properties": {"x": keyword}}
    assert fault(spark, schema, {"x": {}}) == "unsupported_schema" and fault(spark, schema, {}) == "missing"
