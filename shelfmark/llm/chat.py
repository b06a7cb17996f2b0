"""Chat formatting with tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by identifier within their conversation, ordered so that each call follows the calls it
depends on and each result its call, checked against the schema of their tool at every depth, and written as canonical
JSON: no blanks, keys in order at every depth.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import dealt_join
from shelfmark.shared import settled, tabled

CALLS = "conv_id bigint, call_id string, name string, arguments string, after array<string>, place bigint"
IN_ROW = 2_000  # calls of a conversation that are put in order within one row; larger conversations go by rounds
SCHEMA_BYTES = 8_000_000  # of names and schemas in all, up to which they are broadcast
#: What can be wrong with a call; the first that holds is told.
FAULTS = ("unknown_tool", "not_json", "missing", "type", "extra", "value", "unsupported_schema")
#: Keywords of a schema that are checked, and those that ask for nothing; any other is told as unsupported_schema.
CHECKED = ("type", "required", "properties", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern")
ASK_NOTHING = ("title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly")

#: The schemas of the two tools that plain turns are read as calls of.
TURN_SCHEMAS = (
    ("answer", '{"type":"object","required":["text","turn"],"additionalProperties":false,"properties":{"text":{"type":"string","maxLength":300},"turn":{"type":["integer","null"],"minimum":0},"detail":{"type":"object","required":["lines","words"],"properties":{"lines":{"type":"integer","maximum":6},"words":{"type":"array","items":{"type":"integer","minimum":1,"maximum":45}}}}}}'),
    ("configure", '{"type":"object","required":["text"],"properties":{"text":{"type":"string","minLength":40},"turn":{"type":"integer"},"detail":{"type":"object"}}}'),
)


def _levels(calls: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """conv_id, call_id, level for conversations where a call depends on one at a later place.

    The level is the number of calls in the longest chain that a call waits for; a call in a cycle, or behind one, has level
    -1. A conversation of up to in_row calls is one row of numbers; larger ones go by rounds over joins.
    """
    deps = calls.select("conv_id", "call_id", "place", F.explode("after").alias("dep"))
    links = deps.join(calls.select("conv_id", F.col("call_id").alias("dep"), F.col("place").alias("dep_place")), ["conv_id", "dep"]).filter("dep <> call_id")
    odd = links.filter("dep_place > place").select("conv_id").distinct()
    links = tabled(links.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "dep").distinct())
    waits = links.groupBy("conv_id", "call_id").agg(F.collect_list("dep").alias("deps"))
    state = calls.join(links.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "call_id").distinct()
    many = tabled(state.groupBy("conv_id").count().filter(F.col("count") > in_row).select("conv_id"))
    rows = state.join(many, "conv_id", "left_anti").join(waits, ["conv_id", "call_id"], "left").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("call_id", "deps"))).alias("calls"))
    near = rows.select("conv_id", F.explode(F.arrays_zip(F.col("calls.call_id").alias("call_id"), longest_chains("calls").alias("level"))).alias("x")).select("conv_id", "x.call_id", F.col("x.level").cast("int").alias("level"))
    if many.isEmpty():
        return near
    return near.unionByName(_rounds(state.join(many, "conv_id", "left_semi"), links.join(many, "conv_id", "left_semi")))


def longest_chains(calls: str) -> Column:
    """Levels of an array of (call_id, deps): each pass gives a call one more than the highest of those it waits for, until
    nothing changes; what still grows after as many passes as there are calls waits for itself."""
    none = F.array().cast("array<int>")
    ids = F.transform(calls, lambda c: c["call_id"])
    places = F.transform(calls, lambda c: F.coalesce(F.transform(c["deps"], lambda d: (F.array_position(ids, d) - 1).cast("int")), none))
    start = F.transform(calls, lambda c: F.lit(0))

    def climbed(wait: Column) -> Column:
        passed = lambda now: F.transform(wait, lambda own: F.coalesce(F.array_max(F.transform(own, lambda i: F.get(now, i))) + 1, F.lit(0)))
        step = lambda a, _: F.when(a["still"], a).otherwise(_let(passed(a["now"]), lambda n: F.struct(n.alias("now"), (n == a["now"]).alias("still"))))
        return F.aggregate(F.sequence(F.lit(1), F.size(wait)), F.struct(start.alias("now"), F.lit(False).alias("still")), step, lambda a: a["now"])

    return F.transform(_let(places, climbed), lambda n: F.when(n >= F.size(calls), -1).otherwise(n))


def _rounds(state: DataFrame, links: DataFrame) -> DataFrame:
    """Levels by rounds: each gives the next level to calls that wait for nothing, and takes them off the counts of those that
    wait for them. What still waits when a round frees nothing is in a cycle, or behind one."""
    waits = links.groupBy("conv_id", "call_id").agg(F.count("*").alias("waits"))
    state = state.join(waits, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(None).cast("int").alias("level"))
    for level in count():
        state = settled(state.withColumn("level", F.coalesce("level", F.when(F.col("waits") == 0, F.lit(level)))))
        freed = state.filter(F.col("level") == level).select("conv_id", F.col("call_id").alias("dep"))
        if freed.isEmpty():
            return state.select("conv_id", "call_id", F.coalesce("level", F.lit(-1)).alias("level"))
        less = links.join(freed, ["conv_id", "dep"], "left_semi").groupBy("conv_id", "call_id").agg(F.count("*").alias("less"))
        state = state.join(less, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("waits") - F.coalesce("less", F.lit(0))).alias("waits"), "level")


def _is(kind: Column, t: Column) -> Column:
    """Whether a variant whose type is t is of a JSON schema type."""
    whole = t.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | t.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(kind == "string", t == "STRING").when(kind == "integer", whole).when(kind == "number", whole | t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"))
        .when(kind == "boolean", t == "BOOLEAN").when(kind == "array", t.startswith("ARRAY")).when(kind == "object", t.startswith("OBJECT")).when(kind == "null", t == "VOID").otherwise(False)
    )


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def faults(value: Column, schema: Column, depth: int) -> Column:
    """What of FAULTS a variant has against a JSON schema (a variant), as places in FAULTS, by the keywords in CHECKED.

    A level's values are checked together, and lead to those of the next; `depth` levels, as many as schemas have.
    """
    pairs = lambda v, s: F.struct(v.alias("v"), s.alias("s"))
    begin = F.struct(F.array(pairs(value, schema)).alias("todo"), F.array().cast("array<int>").alias("found"))

    def step(a: Column, _: Column) -> Column:
        told = F.transform(a["todo"], lambda x: _told(x["v"], x["s"]))
        return F.when(F.size(a["todo"]) == 0, a).otherwise(_let(told, lambda t: F.struct(
            F.flatten(F.transform(t, lambda x: x["within"])).alias("todo"), F.concat(a["found"], F.flatten(F.transform(t, lambda x: x["found"]))).alias("found"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), begin, step, lambda a: a["found"])


def _told(value: Column, schema: Column) -> Column:
    """found: a value's own faults; within: the values in it, each with its schema."""
    strings, none, no = "array<string>", F.array().cast("array<string>"), lambda c: F.coalesce(c, F.lit(False))
    of = lambda path, kind: F.try_variant_get(schema, path, kind)
    place = lambda name: F.lit(FAULTS.index(name))
    names = lambda m: F.coalesce(F.map_keys(m), none)
    kinds = F.coalesce(of("$.type", strings), F.when(F.schema_of_variant(of("$.type", "variant")) == "STRING", F.array(of("$.type", "string"))), none)
    t = F.schema_of_variant(value)
    parts = F.struct(
        t.alias("t"), F.when(t.startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>")).alias("given"),
        F.when(t.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).alias("items"), kinds.alias("kinds"), of("$.properties", "map<string,variant>").alias("known"))

    def body(b: Column) -> Column:
        t, given, items, known = b["t"], b["given"], b["items"], b["known"]
        beyond = lambda n, least, most, kind: no(n < of(least, kind)) | no(n > of(most, kind))
        text = F.try_variant_get(value, "$", "string")
        of_value = F.when(_is(F.lit("number"), t), beyond(F.try_variant_get(value, "$", "double"), "$.minimum", "$.maximum", "double")).when(
            t == "STRING", beyond(F.length(text), "$.minLength", "$.maxLength", "bigint") | no(~F.rlike(text, of("$.pattern", "string")))).when(
            t.startswith("ARRAY"), beyond(F.size(items), "$.minItems", "$.maxItems", "bigint"))
        other = no(~F.exists(of("$.enum", "array<variant>"), lambda e: F.to_json(e) == F.to_json(value))) | no(F.to_json(of("$.const", "variant")) != F.to_json(value))
        lacks = lambda have, asked: F.size(F.array_except(asked, have)) > 0
        asked = names(F.try_variant_get(schema, "$", "map<string,variant>"))
        more = of("$.additionalProperties", "variant")
        odd = lacks(F.array(*map(F.lit, (*CHECKED, *ASK_NOTHING))), asked) | no(F.schema_of_variant(more) != "BOOLEAN")
        found = F.array_compact(F.array(
            F.when(given.isNotNull() & no(lacks(names(given), F.array_compact(of("$.required", strings)))), place("missing")),
            F.when((F.size(b["kinds"]) > 0) & ~no(F.exists(b["kinds"], lambda k: _is(k, t))), place("type")),
            F.when(given.isNotNull() & no(~of("$.additionalProperties", "boolean")) & lacks(names(known), names(given)), place("extra")),
            F.when(other | no(of_value), place("value")), F.when(odd, place("unsupported_schema"))))
        entries = F.transform(F.array_intersect(names(given), names(known)), lambda k: F.struct(F.element_at(given, k).alias("v"), F.element_at(known, k).alias("s")))
        one = of("$.items", "variant")
        elements = F.when(one.isNotNull(), F.transform(items, lambda v: F.struct(v.alias("v"), one.alias("s"))))
        return F.struct(found.alias("found"), F.concat(entries, F.coalesce(elements, F.array().cast("array<struct<v:variant,s:variant>>"))).alias("within"))

    return _let(parts, body)


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with arguments as a variant (`parsed`) and `fault`: null, or the first of FAULTS that holds.

    Of several schemas of one name the least text is the schema; a schema that is no JSON object allows any object. Schemas
    of up to SCHEMA_BYTES in all, as counted, are broadcast; larger tables are joined with hot names dealt.
    """
    known = schemas.filter("name is not null").groupBy("name").agg(F.min("schema").alias("schema"))
    # A schema is at most as deep as it has keywords that lead to others.
    nested = F.regexp_count(F.coalesce("schema", F.lit("")), F.lit('"(properties|items)"')) + 1
    size, depth = known.agg(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("schema"), F.lit(0)) + 16), F.max(nested)).first()
    size = size or 0
    known = known.select("name", F.lit(True).alias("known"), F.try_parse_json("schema").alias("schema"))
    both = calls.join(F.broadcast(known), "name", "left") if size <= SCHEMA_BYTES else dealt_join(calls, known, ["name"], calls.count())
    both = both.withColumn("parsed", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    told = F.get(F.array(*map(F.lit, FAULTS)), F.array_min(faults(F.col("parsed"), F.col("schema"), depth or 1)))
    fault = F.when(F.col("known").isNull(), "unknown_tool").when(~is_object, "not_json").otherwise(told)
    return both.withColumn("fault", fault).drop("schema", "known")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, n_calls, n_results, n_linked, n_invalid, n_orphans, n_cyclic, messages (canonical JSON) per conversation.

    calls: see CALLS; results: conv_id, call_id, content, place; schemas: name, schema (JSON). Of calls that share an
    identifier the first by place, then by arguments and name, is the call, the rest count as invalid but stay in messages;
    of results of one call the first by place, then by content, is linked and later ones stay as orphans. Null identifiers
    link to nothing. Calls stand in dependency order, by place among free ones; calls in cycles come last; each linked result
    follows its call; orphans come after all calls. Null arguments are not JSON, null contents stay null, texts of any length
    stay whole; empty tables give no conversations; other columns are not read.
    """
    calls = calls.select("conv_id", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"), "place")
    levels = _levels(calls.filter("call_id is not null").select("conv_id", "call_id", "after", "place"))
    of_call = Window.partitionBy("conv_id", "call_id")
    told = checked(calls, schemas).withColumn("first", F.col("call_id").isNotNull() & (F.row_number().over(of_call.orderBy("place", "arguments", "name")) == 1))
    told = told.join(levels, ["conv_id", "call_id"], "left")
    answers = results.select("conv_id", "call_id", "content", "place").withColumn("first", F.col("call_id").isNotNull() & (F.row_number().over(of_call.orderBy("place", "content")) == 1))
    known = told.filter("first").select("conv_id", "call_id", F.col("place").alias("call_place"), F.col("level").alias("call_level"))
    answers = answers.join(known.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    linked = F.col("first") & F.col("call_place").isNotNull()
    last = F.lit(2147483647)
    rank = lambda level: F.when(level == -1, last - 1).otherwise(F.coalesce(level, F.lit(0)))
    call_message = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id"), F.col("fault"), F.col("name"), F.lit("call").alias("role")))
    result_message = F.to_json(F.struct("call_id", "content", linked.alias("linked"), F.lit("result").alias("role")))
    one = told.select("conv_id", F.struct(rank(F.col("level")).alias("level"), F.col("place"), F.lit(0).alias("after"), call_message.alias("json")).alias("m"),
        F.lit(1).alias("call"), F.lit(0).alias("linked"), (F.col("fault").isNotNull() | ~F.col("first")).cast("int").alias("invalid"), (F.col("first") & F.coalesce(F.col("level") == -1, F.lit(False))).cast("int").alias("cyclic"))
    two = answers.select("conv_id", F.struct(F.when(linked, rank(F.col("call_level"))).otherwise(last).alias("level"), F.when(linked, F.col("call_place")).otherwise(F.col("place")).alias("place"), F.lit(1).alias("after"), result_message.alias("json")).alias("m"),
        F.lit(0).alias("call"), linked.cast("int").alias("linked"), F.lit(0).alias("invalid"), F.lit(0).alias("cyclic"))
    grouped = one.unionByName(two).groupBy("conv_id").agg(
        F.sum("call").alias("n_calls"), F.sum(1 - F.col("call")).alias("n_results"), F.sum("linked").alias("n_linked"), F.sum("invalid").alias("n_invalid"),
        F.sum((1 - F.col("call")) * (1 - F.col("linked"))).alias("n_orphans"), F.sum("cyclic").alias("n_cyclic"), F.sort_array(F.collect_list("m")).alias("m"))
    return grouped.withColumn("messages", F.concat(F.lit("["), F.array_join(F.col("m.json"), ","), F.lit("]"))).drop("m")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text).

    A turn whose text is a JSON object with a call_id is what it says: with a name a call, else a result. Other turns of
    users are calls of `answer`, of systems of `configure`, with identifier turn-N; any other turn is the result of the
    user's turn before it in number (N - 1). A plain call of `answer` waits for the call two turns before it, and for that of
    the turn whose number is its number of words modulo 8, which may come later, or wait for it in turn. Null text is empty.
    """
    body = F.coalesce("text", F.lit(""))
    parsed = F.when(F.ltrim(body).startswith("{"), F.try_parse_json(body))
    get = lambda path, kind="string": F.try_variant_get("parsed", path, kind)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("place"), F.coalesce("role", F.lit("")).alias("role"), body.alias("text"), parsed.alias("parsed"))
    rows = rows.withColumn("given", F.when(F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False)), get("$.call_id")))
    given = F.col("given").isNotNull()
    is_call = F.when(given, get("$.name").isNotNull()).otherwise(F.col("role").isin("user", "system"))
    words = F.size(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""))
    detail = F.struct((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.array(words).alias("words"))
    args = F.when(given, F.to_json(get("$.arguments", "variant"))).otherwise(F.to_json(F.struct(detail.alias("detail"), "text", F.col("place").alias("turn"))))
    name = F.when(given, get("$.name")).when(F.col("role") == "user", "answer").otherwise("configure")
    turn = lambda n: F.concat(F.lit("turn-"), n.cast("string"))
    plain = F.array_compact(F.array(turn(F.col("place") - 2), turn(words % 8)))
    calls = rows.filter(is_call).select(
        "conv_id", F.coalesce("given", turn(F.col("place"))).alias("call_id"), name.alias("name"), args.alias("arguments"),
        F.when(given, F.coalesce(get("$.after", "array<string>"), F.array().cast("array<string>"))).when(F.col("role") == "user", plain).otherwise(F.array().cast("array<string>")).alias("after"), "place")
    results = rows.filter(~is_call).select(
        "conv_id", F.coalesce("given", turn(F.col("place") - 1)).alias("call_id"),
        F.when(given, F.coalesce(get("$.content"), F.lit(""))).otherwise(F.col("text")).alias("content"), "place")
    return calls, results


def format_conversations(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """link() over a table of turns, as `turns_as_calls` reads them; nulls, empty and long texts, repeated rows and an empty
    table as there, and columns other than conv_id, turn, role and text are not read."""
    schemas = schemas if schemas is not None else conversations.sparkSession.createDataFrame(list(TURN_SCHEMAS), "name string, schema string")
    calls, results = turns_as_calls(conversations)
    return link(calls, results, schemas)


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role IN ('user', 'system') AS is_call, role, coalesce(text, '') AS text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda w: w <> '')) AS words,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM conversations),
c AS (
  SELECT conv_id, turn, role, 'turn-' || turn AS call_id, CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS name, text, words, lines,
         CASE WHEN role = 'user' AND (length(text) > 300 OR turn < 0 OR lines > 6 OR words < 1 OR words > 45) THEN 'value' WHEN role = 'system' AND length(text) < 40 THEN 'value' END AS fault
  FROM t WHERE is_call),
d AS (SELECT DISTINCT a.conv_id, a.turn, b.turn AS dep FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 2, a.words % 8) WHERE a.turn <> b.turn AND a.role = 'user'),
odd AS (SELECT DISTINCT conv_id FROM d WHERE dep > turn),
size AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
walk AS (SELECT conv_id, turn, turn AS at, 0 AS steps FROM c WHERE conv_id IN (SELECT conv_id FROM odd)
  UNION SELECT w.conv_id, w.turn, d.dep, w.steps + 1 FROM walk w JOIN d ON d.conv_id = w.conv_id AND d.turn = w.at JOIN size s ON s.conv_id = w.conv_id WHERE w.steps < s.n),
levels AS (SELECT conv_id, turn, CASE WHEN max(steps) = max(n) THEN 2147483646 ELSE max(steps) END AS level FROM walk JOIN size USING (conv_id) GROUP BY conv_id, turn),
lc AS (SELECT c.*, coalesce(level, 0) AS level FROM c LEFT JOIN levels USING (conv_id, turn)),
r AS (SELECT a.conv_id, a.turn, 'turn-' || (a.turn - 1) AS call_id, a.text, c.turn AS call_turn, c.level FROM t a LEFT JOIN lc c ON a.conv_id = c.conv_id AND c.turn = a.turn - 1 WHERE NOT a.is_call),
m AS (
  SELECT conv_id, 0 AS orphan, level, turn AS place, 0 AS after, 1 AS is_call, CAST(fault IS NOT NULL AS INT) AS invalid, CAST(level = 2147483646 AS INT) AS cyclic,
         '{"arguments":{"detail":{"lines":' || lines || ',"words":[' || words || ']},"text":' || to_json(text) || ',"turn":' || turn || '},"call_id":"' || call_id || '",' || CASE WHEN fault IS NULL THEN '' ELSE '"fault":"' || fault || '",' END || '"name":"' || name || '","role":"call"}' AS j FROM lc
  UNION ALL
  SELECT conv_id, CAST(call_turn IS NULL AS INT), CASE WHEN call_turn IS NULL THEN 2147483647 ELSE level END, coalesce(call_turn, turn), 1, 0, 0, 0,
         '{"call_id":"' || call_id || '","content":' || to_json(text) || ',"linked":' || CASE WHEN call_turn IS NULL THEN 'false' ELSE 'true' END || ',"role":"result"}' FROM r)
SELECT conv_id, CAST(sum(is_call) AS BIGINT) AS n_calls, CAST(sum(1 - is_call) AS BIGINT) AS n_results, CAST(sum((1 - is_call) * (1 - orphan)) AS BIGINT) AS n_linked,
       CAST(sum(invalid) AS BIGINT) AS n_invalid, CAST(sum((1 - is_call) * orphan) AS BIGINT) AS n_orphans, CAST(sum(cyclic) AS BIGINT) AS n_cyclic,
       '[' || string_agg(j, ',' ORDER BY level, place, after, j) || ']' AS messages
FROM m GROUP BY conv_id
"""
