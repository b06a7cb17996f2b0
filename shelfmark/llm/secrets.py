"""Secret scans with multipart credential linking, in DataFrame functions only.

Positions come from the lengths of what lies between matches: splitting a text on a pattern and extracting the pattern's
matches give both sides, and a running sum over them gives code point offsets. Parts of a document then stand in one
ordered sequence, where the nearest part of each role before and after a weak candidate is a running extreme: an interval
join within a scope that makes one row a part however many parts a document has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import HEAVY_KEYS, dealt_join, free_name, parted, text_key, whole_text, written

SCOPE = 200

#: The base patterns, in the order of kinds. A run that is long enough is the whole run either way for access and hex.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak candidates: reported only beside complementary parts.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
WEAK_ID = r"""(?i:client|account|access_?key|user)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{4,}"""
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?"""

#: One of these is in the lower-cased text of any assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: kind, pattern, its place in orders by kind, whether it stands by itself, what it is part of a credential as.
KINDS = (
    ("assign", ASSIGN, 0, True, "secret"),
    ("access", ACCESS, 1, True, "id"),
    ("hex", HEX, 2, True, "secret"),
    ("linked_secret", WEAK_SECRET, 3, False, "secret"),
    ("linked_id", WEAK_ID, 4, False, "id"),
    ("linked_endpoint", ENDPOINT, 5, False, "endpoint"),
)


MATCHES = "array<struct<kind:string,nth:int,gap:int,len:int,passes:boolean>>"


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Of each match: kind, its number, code points between it and the one before, its own, and whether it passes."""
    regex = F.lit(pattern)
    passes = F.regexp_extract_all(text, regex, F.lit(2)) if kind == "assign" else F.regexp_extract_all(text, regex, F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), passes.alias("value"))
    made = F.transform(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("len"), (F.length(z["value"]) >= 6).alias("passes")),
    )
    return F.when(_may_have(text, kind) & text.rlike(pattern), made).otherwise(F.array().cast(MATCHES))


def _may_have(text: Column, kind: str) -> Column:
    """Cheap looks before a pattern: for words that any match holds, and for weak kinds for an identifier to link with."""
    low = F.lower(text)
    an_id = F.contains(text, F.lit("AKIA")) | (F.contains(low, F.lit("id")) & text.rlike(WEAK_ID))
    if kind == "assign":
        return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in ASSIGN_WORDS])
    if kind in ("access", "hex"):
        return F.contains(text, F.lit("AKIA")) if kind == "access" else F.lit(True)
    if kind == "linked_id":
        return F.contains(low, F.lit("id"))
    return an_id if kind == "linked_secret" else F.contains(text, F.lit("://")) & an_id


def scan(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash and found (sorted array of struct<start, place, end, kind, base>) for each row of docs.

    Base spans always stay. A weak one stays if it overlaps no base span and its complement lies within `scope` code
    points: an identifier for a secret, a secret for an identifier, both for an endpoint. Null and empty texts have
    nothing; a text may have any number of matches; repeated rows and null keys each get their row; an empty table gives
    none; other columns are not read. One shuffle, of matches.
    """
    body = whole_text(text)
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("text_hash"), F.monotonically_increasing_id().alias("_row"), body.alias("_text"))
    found = F.concat(*[_matches(F.col("_text"), kind, pattern) for kind, pattern, *_ in KINDS])
    parts = rows.select("_key", "text_hash", "_row", F.explode_outer(found).alias("m"))
    parts = parts.select("_key", "text_hash", "_row", "m.*").repartition("_row")  # all that follows is within a row
    in_kind = Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(in_kind)
    at = lambda i: F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k[0], k[i])]), F.col("kind"))
    spans = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).select("_key", "text_hash", "_row", "kind", "start", "end", "passes", at(2).alias("place"), at(3).alias("base"), at(4).alias("role"))
    spans = spans.filter(F.col("kind").isNull() | F.col("passes") | ~F.col("base"))
    before = Window.partitionBy("_row").orderBy("start", "end", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for role in ("id", "secret"):
        spans = spans.withColumn(f"near_{role}_before", F.max(F.when(F.col("role") == role, F.col("end"))).over(before))
    spans = spans.withColumn("base_before", F.max(F.when(F.col("base"), F.col("end"))).over(before))
    for role in ("id", "secret"):
        spans = spans.withColumn(f"near_{role}_after", F.min(F.when(F.col("role") == role, F.col("start"))).over(after))
    spans = spans.withColumn("base_after", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    near = {r: F.coalesce(F.col("start") - F.col(f"near_{r}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"near_{r}_after") - F.col("end") <= scope, F.lit(False)) for r in ("id", "secret")}
    clear = F.coalesce(F.col("base_before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("base_after") >= F.col("end"), F.lit(True))
    linked = F.when(F.col("role") == "secret", near["id"]).when(F.col("role") == "id", near["secret"]).otherwise(near["id"] & near["secret"])
    keep = F.col("kind").isNotNull() & (F.col("base") | (clear & linked))
    span = F.struct("start", "place", "end", "kind", "base")
    return spans.groupBy("_row", "_key", "text_hash").agg(F.sort_array(F.collect_list(F.when(keep, span))).alias("found")).select(F.col("_key").alias(key), "text_hash", "found")


def _digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of base kinds, the digest of base spans and all spans of each document.

    Null and empty texts have none; every row of docs gives a row, whatever its doc_id; an empty table gives none; only
    doc_id and text are read.
    """
    found = scan(docs, scope)
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: ~s["base"])).cast("bigint").alias("n_linked"))


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every found span of text replaced by `mask`; all rows and columns stay, n_chars follows the text.

    Overlapping spans are masked as one. Null and empty texts stay as they are, an empty table stays empty, repeated rows
    are each masked, and other columns keep their values whatever their names. Spans follow from the text alone, so they are
    joined by two hashes of it, and only rows that may have any take part.
    """
    empty = "array<struct<start:bigint,end:bigint>>"
    # Spans are sorted by start; each begins no earlier than the furthest end so far, or it joins what is open.
    joined = F.aggregate(
        "found", F.array().cast(empty),
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] < F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))))),
    )
    one, two, cuts = (free_name(docs, n) for n in ("_h1", "_h2", "_cuts"))
    h1, h2 = text_key(F.col("text"))
    key = F.struct(h1, h2)
    spans = scan(docs.select(key.alias("doc_id"), "text"), scope).filter(F.size("found") > 0)
    spans = written(spans.select(F.col("doc_id._h1").alias(one), F.col("doc_id._h2").alias(two), joined.alias(cuts)))
    heavy = spans.groupBy(one, two).agg(F.count("*").alias("_n")).filter(F.col("_n") * HEAVY_KEYS > F.lit(spans.count())).select(one, two)
    some, others = parted(docs.withColumn(one, h1).withColumn(two, h2), F.col(one), spans.select(one).distinct())
    both = dealt_join(some, spans.dropDuplicates([one, two]), [one, two], 0, heavy=heavy)
    n, at = F.size(cuts), F.col(cuts)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col("text"),
        F.when(i == 0, F.lit(1)).otherwise(F.get(at, i - 1)["end"].cast("int") + 1),
        (F.when(i == n, F.length("text")).otherwise(F.get(at, i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"])).cast("int"),
    ))
    out = both.withColumn("text", F.when(at.isNull(), F.col("text")).otherwise(F.array_join(pieces, mask)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(at.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return others.select(*docs.columns).unionByName(out.select(*docs.columns))
