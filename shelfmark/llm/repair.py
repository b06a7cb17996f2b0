"""Repair of the turns of conversations: backward costs over turn and grammar state, then a greedy walk along the cheapest edits.

A conversation is right if the first letters of its roles are `(s?(ua)+)?`. Edits: keep a turn (0), give it the role user or
assistant (2), delete it (3, and a must for blank and repeated turns), insert an empty turn of user or assistant (2); a
truncated turn that stays adds 1. Of all cheapest lists of edits the one is taken whose initials D, I, K, R are least.

Turns are sorted by range, not grouped: a conversation that lies within a task is mended on the spot, one that lies over
several tasks or beyond SEGMENT turns goes as segments. A segment is summed up as the costs from each state before it to
each state after it, so costs run backward over segments (16 numbers each), ends run forward over them (4 numbers each), and
then every segment is walked by itself. No task holds more than a segment's turns, whatever a conversation's share of all.

Defined cases: null role and text are one space (so such a text is blank, such a role is none of the grammar's), null turns
come first, and a null conv_id is a conversation. Turns of one number go by role, then text. A text of any length is one
value of its row and read whole; other columns are ignored, however named; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import parted, scratch_dir, shuffle_width, tidy, written

SEGMENT = 20_000  # turns of a segment, at most
SEGMENT_BYTES = 8 << 20  # of its texts; a longer text is alone
BLANKS = " \t\n\x0b\x0c\r"
PREFIX = 256  # characters of a text that deal turns of one number and role to ranges

# States: nothing yet, after system, after user, after assistant.
NEXT = (2, 2, 3, 2)  # the state after a turn of the role that may follow by insertion or a new role
ROLES = ("user", "user", "assistant", "user")  # that role
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
END = (0, 4, 2, 0)  # what insertions after the last turn cost
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}

STATS = "turns long, first_turn long, last_turn long, numbers long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
TURNS = "array<struct<code: string, role: string, text: string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns after damage by crc32 of `conv_id:turn` (null: one space) modulo 20.

    0 drops a turn (gone is true and it counts for nothing but its conversation's being there), 1 empties its text, 2 takes
    its `[.!?]` away, 3 repeats it, 4 gives it to the user. Every row of an empty, repeated or null input is damaged alike.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def before(code: str, after: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Costs to go from each state before a turn (and insertions before it), from those after it."""
    own = [3 + x for x in after]
    if code != "D":
        cut = int(code.isupper())
        for q in range(4):
            own[q] = min(own[q], 2 + cut + after[NEXT[q]])
        for q, to in KEPT.get(code.lower(), {}).items():
            own[q] = min(own[q], cut + after[to])
    user, assistant = min(own[2], 2 + own[3]), min(own[3], 2 + own[2])
    return min(own[0], 2 + user), min(own[1], 2 + user), user, assistant


def costs(codes: str, goal: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go before each turn, and the goal after the last."""
    out = [tuple(goal)]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def walk(codes: str, to_go: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, list[tuple[int, str]], int]:
    """Edits, what stays (number of the turn or -1, role or '' as it is) and the state after, by the least initial that is cost-tight.

    last: insertions after the last turn are of this segment too.
    """
    edits, stays, i = [], [], 0
    while True:
        now = to_go[i][state]
        if i == len(codes):
            if not last or now == 0:
                return "".join(edits), stays, state
            edit = "I"
        else:
            code, after = codes[i], to_go[i + 1]
            cut = int(code.isupper())
            if 3 + after[state] == now:
                edit = "D"
            elif 2 + to_go[i][NEXT[state]] == now:
                edit = "I"
            elif state in KEPT.get(code.lower(), {}) and cut + after[KEPT[code.lower()][state]] == now:
                edit = "K"
            else:
                edit = "R"
        edits.append(edit)
        if edit == "K":
            stays.append((i, ""))
            state = KEPT[codes[i].lower()][state]
        elif edit != "D":
            stays.append((i if edit == "R" else -1, ROLES[state]))
            state = NEXT[state]
        i += edit != "I"


def rebuilt(turns: list[dict], stays: list[tuple[int, str]]) -> list[dict]:
    return [{"role": role or turns[i]["role"], "text": turns[i]["text"] if i >= 0 else ""} for i, role in stays]


class _Segment:
    """Turns of one conversation that follow each other, with what is counted of them."""

    def __init__(self, conv) -> None:
        self.conv, self.rows, self.size = conv, [], 0
        self.stats: dict = dict.fromkeys(("turns", "numbers", "blank", "duplicate", "truncated", "illegal"), 0) | dict.fromkeys(("first_turn", "last_turn", "first_role", "last_role"))

    def add(self, turn, role: str, text: str, code: str, repeated: bool) -> None:
        s, fault = self.stats, {"B": "blank", "D": "duplicate"}.get(code, "duplicate" if repeated else "truncated" if code.isupper() else "")
        if fault:
            s[fault] += 1
        if turn is not None and (s["last_turn"] is None or turn != s["last_turn"]):
            s["numbers"] += 1
            s["first_turn"] = turn if s["first_turn"] is None else s["first_turn"]
            s["last_turn"] = turn
        if s["turns"] and s["last_role"] + role[:1] not in LEGAL:
            s["illegal"] += 1
        s["first_role"] = role[:1] if s["first_role"] is None else s["first_role"]
        s["last_role"] = role[:1]
        s["turns"] += 1
        self.rows.append({"code": "D" if fault in ("blank", "duplicate") else code, "role": role, "text": text})
        self.size += len(text)

    @property
    def codes(self) -> str:
        return "".join(r["code"] for r in self.rows)

    def row(self, number: int, whole: bool) -> dict:
        out = {"conv_id": self.conv, "piece": number, "whole": whole, **self.stats, "cost": None, "audit": None, "repaired": None, "sums": None, "rows": None}
        if whole:
            to_go = costs(self.codes, END)
            out["audit"], stays, _ = walk(self.codes, to_go, 0, True)
            return out | {"cost": to_go[0][0], "repaired": rebuilt(self.rows, stays)}
        ends = [costs(self.codes, tuple(0 if q == p else FAR for q in range(4)))[0] for p in range(4)]
        return out | {"sums": [ends[q][p] for p in range(4) for q in range(4)], "rows": self.rows}


def _segments(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        now, previous, begun, out, held = None, None, False, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        out.append(now.row(number, begun))
                        held, number = held + now.size + 200 * len(now.rows), number + 1
                        begun = True  # a conversation that begins here, after another
                    now, previous = _Segment(r["conv_id"]), None
                elif len(now.rows) >= SEGMENT or now.size >= SEGMENT_BYTES:
                    out.append(now.row(number, False))
                    held, number, begun, now = held + now.size + 200 * len(now.rows), number + 1, False, _Segment(r["conv_id"])
                if not r["gone"]:
                    own = (r["role"], r["text"])
                    now.add(r["turn"], *own, r["code"], r["late"] or own == previous)
                    previous = own
                if held >= SEGMENT_BYTES:
                    yield from pa.Table.from_pylist(out, schema).to_batches()
                    out, held = [], 0
        if now is not None:
            yield from pa.Table.from_pylist([*out, now.row(number, False)], schema).to_batches()

    return tidy(run)


def _settled(group: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's segments (16 numbers each) the costs to go after each, and the conversation's counts in the first's row."""
    group = group.sort_values("piece")
    rows, after = [], list(END)
    for r in group.iloc[::-1].itertuples():
        rows.append({"piece": r.piece, "after": after, "last": not rows})
        after = [min(r.sums[4 * p + q] + after[q] for q in range(4)) for p in range(4)]
    rows = rows[::-1]
    counts = {n: int(group[n].sum()) for n in ("blank", "duplicate", "truncated", "illegal", "numbers")} | {"cost": int(after[0])}
    low = high = role = None
    for r in group.itertuples():
        if r.turns:
            counts["illegal"] += role is not None and role + r.first_role not in LEGAL
            role = r.last_role
        if r.numbers:
            counts["numbers"] -= high is not None and high == r.first_turn
            low, high = r.first_turn if low is None else low, r.last_turn
    counts["gaps"] = 0 if low is None else int(high - low + 1 - counts["numbers"])
    del counts["numbers"]
    rows[0] |= counts
    out = pd.DataFrame(rows, columns=["piece", "after", "last", *counts])
    out.insert(0, "conv_id", group["conv_id"].iloc[0])
    return out.astype({n: "Int64" for n in counts})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a segment, from each state before it."""
    for batch in batches:
        for r in batch.to_pylist():
            codes = "".join(x["code"] for x in r["rows"])
            to_go = costs(codes, tuple(r["after"]))
            yield pa.RecordBatch.from_pylist([{"piece": r["piece"], "ends": [walk(codes, to_go, q, r["last"])[2] for q in range(4)]}], pa.schema([("piece", pa.int64()), ("ends", pa.list_(pa.int32()))]))


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    group, state, out = group.sort_values("piece"), 0, []
    for ends in group["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"piece": group["piece"], "start": out})


def _walked(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = "".join(x["code"] for x in r["rows"])
                r["audit"], stays, _ = walk(codes, costs(codes, tuple(r["after"])), r["start"], r["last"])
                r["repaired"] = rebuilt(r["rows"], stays)
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names}], schema)

    return tidy(run)


def _fields(conv: str) -> str:
    return f"conv_id {conv}, piece long, whole boolean, {STATS}, cost long, audit string, repaired array<struct<role: string, text: string>>, sums array<long>, rows {TURNS}"


def ordered(turns: DataFrame) -> DataFrame:
    """Turns dealt to ranges of conversation and number, in order, with their codes and whether role and text are of an earlier number.

    A code is the role's letter (x: none of the grammar's), a capital if the text is truncated, B if it is blank.
    """
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(body == "", "B").when(F.right(body, F.lit(1)).isin(".", "!", "?"), code).otherwise(F.upper(code))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    said = [F.xxhash64(F.lit(n), F.col("conv_id").isNull(), "conv_id", "role", "text").alias(f"_h{n}") for n in (1, 2)]
    rows = rows.select("*", code.alias("code"), *said)
    several = F.col("null_turn") & F.col("least").isNotNull() | (F.col("least") < F.col("most"))
    again = rows.filter("not gone and code <> 'B'").groupBy("_h1", "_h2").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("null_turn")).filter(several)
    place = scratch_dir(turns.sparkSession)
    again = written(again.drop("most"), place)
    maybe, alone = parted(rows, F.col("_h1"), again.select("_h1"))
    late = F.coalesce((F.col("turn") > F.col("least")) | (F.col("null_turn") & F.col("turn").isNotNull()), F.lit(False))
    both = maybe.join(again, ["_h1", "_h2"], "left").withColumn("late", late).unionByName(alone.withColumn("late", F.lit(False)), allowMissingColumns=True)
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    both = both.select("conv_id", "turn", "role", "text", "gone", "code", "late")
    return both.repartitionByRange(shuffle_width(turns.sparkSession), *keys, F.left("text", F.lit(PREFIX))).sortWithinPartitions(*keys, "text")


def mended(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that lie within one task (a row each), and segments of the others (piece orders them): each with the audit
    and the repaired turns; counts are in the first segment's row."""
    conv = turns.schema["conv_id"].dataType.simpleString()
    fields = StructType.fromDDL(_fields(conv))
    found = written(ordered(turns).mapInArrow(_segments(to_arrow_schema(fields)), fields))
    whole = found.filter("whole").withColumn("gaps", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("numbers"), F.lit(0)))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "gaps"]
    cut = found.filter("not whole")
    settled = written(cut.drop("whole", "cost", "audit", "repaired", "rows").fillna(0, ["first_turn", "last_turn"]).groupBy("conv_id").applyInPandas(_settled, f"conv_id {conv}, piece long, after array<long>, last boolean, " + ", ".join(f"{c} long" for c in counts)))
    ends = cut.select("piece", "rows").join(settled.select("piece", "after", "last"), "piece").mapInArrow(tidy(_ends), "piece long, ends array<int>")
    starts = ends.join(settled.select("piece", "conv_id"), "piece").groupBy("conv_id").applyInPandas(_starts, "piece long, start int")
    out = StructType.fromDDL(f"conv_id {conv}, piece long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired array<struct<role: string, text: string>>")
    walked = cut.select("piece", "rows").join(settled, "piece").join(starts, "piece").mapInArrow(_walked(to_arrow_schema(out)), out)
    return whole.select(*out.names), written(walked)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, piece, place, role, text: the repaired turns, in order of piece and place within a conversation."""
    whole, cut = mended(turns)
    return whole.unionByName(cut).select("conv_id", "piece", F.posexplode("repaired").alias("place", "turn")).select("conv_id", "piece", "place", "turn.role", "turn.text")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations whose segments come in order; texts pass through the hash one by one."""
    now = None
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield now
                now = {"conv_id": r["conv_id"], "audit": [], "hash": hashlib.sha256(), "any": False}
            now["audit"].append(r["audit"])
            for turn in r["repaired"]:
                now["hash"].update(("\n" if now["any"] else "").encode() + f"{turn['role']}:{turn['text']}".encode())
                now["any"] = True
    if now is not None:
        yield now


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, damaged and repaired.

    A conversation of which the damage leaves nothing has zeros, an empty audit and the hash of the empty string.
    """
    whole, cut = mended(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    conv = conversations.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    near = whole.select("conv_id", *counts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows():
            nonlocal kind
            for b in batches:
                kind = kind or b.schema.field("conv_id").type
                yield b

        for r in _joined(rows()):
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "audit": "".join(r["audit"]), "repaired_sha256": r["hash"].hexdigest()}], pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    said = cut.select("conv_id", "piece", "audit", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(tidy(run), f"conv_id {conv}, audit string, repaired_sha256 string")
    first = cut.filter("cost is not null").select(F.col("conv_id").alias("_conv"), *counts)
    return near.unionByName(said.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*near.columns))


#: Costs and walks of all conversations at once: a round of the first recursion goes a turn back, one of the second an edit on.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key
  FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(0, octet_length(key)), lambda i: [CAST(('0x' || substr(hex(key), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, E' \t\n\x0b\x0c\r') AS body FROM rows
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS earlier FROM placed
), turns AS (
  SELECT conv, i, role, text, initial, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM faults
), sizes AS (SELECT conv, max(i) AS n FROM turns GROUP BY conv),
back AS (
  SELECT conv, n + 1 AS i, CAST(0 AS BIGINT) AS c0, CAST(4 AS BIGINT) AS c1, CAST(2 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS c3 FROM sizes
  UNION ALL
  SELECT conv, i, least(o0, 2 + least(o2, 2 + o3)), least(o1, 2 + least(o2, 2 + o3)), least(o2, 2 + o3), least(o3, 2 + o2) FROM (
    SELECT b.conv, t.i,
      CASE WHEN must THEN 3 + c0 ELSE least(3 + c0, 2 + cut + c2, CASE initial WHEN 's' THEN cut + c1 WHEN 'u' THEN cut + c2 ELSE 1000000000 END) END AS o0,
      CASE WHEN must THEN 3 + c1 ELSE least(3 + c1, 2 + cut + c2, CASE initial WHEN 'u' THEN cut + c2 ELSE 1000000000 END) END AS o1,
      CASE WHEN must THEN 3 + c2 ELSE least(3 + c2, 2 + cut + c3, CASE initial WHEN 'a' THEN cut + c3 ELSE 1000000000 END) END AS o2,
      CASE WHEN must THEN 3 + c3 ELSE least(3 + c3, 2 + cut + c2, CASE initial WHEN 'u' THEN cut + c2 ELSE 1000000000 END) END AS o3
    FROM back b JOIN turns t ON t.conv = b.conv AND t.i = b.i - 1)
), goals AS (
  SELECT conv, i, unnest([0, 1, 2, 3]) AS q, unnest([c0, c1, c2, c3]) AS cost FROM back
), walked AS (
  SELECT conv, CAST(1 AS BIGINT) AS i, 0 AS q, 0 AS step, '' AS edit, CAST(NULL AS VARCHAR) AS said FROM sizes
  UNION ALL
  SELECT conv, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND initial = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END, step + 1, edit,
    CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text WHEN 'I' THEN CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END ELSE CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || text END
  FROM (
    SELECT w.conv, w.i, w.q, w.step, t.initial, t.role, t.text,
      CASE WHEN t.i IS NOT NULL AND 3 + d.cost = g.cost THEN 'D' WHEN 2 + s.cost = g.cost THEN 'I'
        WHEN t.i IS NOT NULL AND NOT must AND ((initial = 's' AND w.q = 0 AND cut + k1.cost = g.cost) OR (((initial = 'u' AND w.q <> 2) OR (initial = 'a' AND w.q = 2)) AND cut + kn.cost = g.cost)) THEN 'K' WHEN t.i IS NOT NULL THEN 'R' END AS edit
    FROM walked w JOIN goals g ON g.conv = w.conv AND g.i = w.i AND g.q = w.q
      LEFT JOIN turns t ON t.conv = w.conv AND t.i = w.i
      LEFT JOIN goals d ON d.conv = w.conv AND d.i = w.i + 1 AND d.q = w.q
      JOIN goals s ON s.conv = w.conv AND s.i = w.i AND s.q = CASE WHEN w.q = 2 THEN 3 ELSE 2 END
      LEFT JOIN goals k1 ON k1.conv = w.conv AND k1.i = w.i + 1 AND k1.q = 1
      LEFT JOIN goals kn ON kn.conv = w.conv AND kn.i = w.i + 1 AND kn.q = CASE WHEN w.q = 2 THEN 3 ELSE 2 END) WHERE edit IS NOT NULL
), audits AS (
  SELECT conv, coalesce(string_agg(edit, '' ORDER BY step), '') AS audit, sha256(coalesce(string_agg(said, E'\n' ORDER BY step) FILTER (said IS NOT NULL), '')) AS repaired_sha256 FROM walked GROUP BY conv
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(c0, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv FROM conversations) o
LEFT JOIN counted USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN (SELECT conv, c0 FROM back WHERE i = 1) USING (conv)
"""
