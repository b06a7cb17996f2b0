"""WARC archives: writing captures, reading records back, and assembling transactions.

Archives go through Spark's text sink: a row is a record and the line separator is the two line ends that close a record,
so commits and retries are Spark's own and any Hadoop path will do; an archive is one gzip member. Reading inflates an
archive as it goes and follows each record's Content-Length, so a worker holds one record beside the archive as it is
stored. Records of one capture are joined through WARC-Concurrent-To.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import HEAVY_KEYS, dealt_join, tidy, written

SMALLEST_SHARED = 100  # bytes from which equal payloads are written once
FILE_BYTES = 32 << 20  # of an archive before it is compressed, by the mean size of payloads
LARGE_PAYLOAD, MOST_BYTES = 256 << 10, 1 << 30  # a payload above the first shares no archive with smaller ones
INFLATE_BYTES = 1 << 20
CRLF = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record less the line ends that close it; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def captures(pages: DataFrame, smallest_shared: int = SMALLEST_SHARED) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, turn, refers_to of each row of pages; refers_to is null for responses.

    Of equal payloads of at least `smallest_shared` bytes the one of the smallest page_id is the response. Rows of one
    page_id and payload are told apart by url, then by number. A null page_id refers to nothing and is a response; null
    html is an empty payload; an empty table gives no rows; other columns are not read. Payloads are dealt by page_id and
    digest, so copies of one page under many numbers don't meet in a task.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    narrow = written(rows.select("page_id", "digest", F.octet_length("payload").alias("n")).filter((F.col("n") >= smallest_shared) & F.col("page_id").isNotNull()))
    n = narrow.count()
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).filter("many > 1")
    heavy = firsts.filter(F.col("many") * HEAVY_KEYS > n).select("digest")
    shared = dealt_join(narrow.drop("n"), firsts.drop("many"), ["digest"], n, "inner", heavy).distinct()
    counted = rows.repartition("page_id", "digest").groupBy("page_id", "digest", "url", "payload").agg(F.count("*").alias("copies"))
    each = counted.join(shared, ["page_id", "digest"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = each.withColumn("turn", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url", "copy")))
    first = F.col("first")
    refers = F.when(first.isNotNull() & ((first != F.col("page_id")) | (F.col("turn") > 1)), first)
    return each.select("page_id", "url", "payload", "digest", F.octet_length("payload").cast("bigint").alias("n_bytes"), "turn", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, smallest_shared: int = SMALLEST_SHARED, date: str = "1970-01-01T00:00:00Z", records_per_file: int | None = None) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of pages to gzipped archives in path.

    Rows as in `captures`; a null url has no target URI. Archives have as many records as make about FILE_BYTES, unless
    their number is given, and no more than MOST_BYTES before they are packed, whatever sizes follow each other: payloads
    above LARGE_PAYLOAD go to archives of their own, as many as fit by the largest of them, one at least. An empty table gives
    an archive without records. Columns beside page_id, url and html are not read.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    mean, largest = pages.agg(F.avg(F.when(size <= LARGE_PAYLOAD, size)), F.max(size)).first()
    captured = captures(pages, smallest_shared)
    fit = lambda most, each: max(3, 3 * int(most / (each + 1_500)))
    small = records_per_file or min(fit(FILE_BYTES, mean or 0), fit(MOST_BYTES, LARGE_PAYLOAD))
    if (largest or 0) <= LARGE_PAYLOAD:
        _written(captured, path, date, small, "overwrite")
    else:
        _written(captured.filter(F.col("n_bytes") <= LARGE_PAYLOAD), path, date, small, "overwrite")
        _written(captured.filter(F.col("n_bytes") > LARGE_PAYLOAD), path, date, records_per_file or fit(FILE_BYTES, largest), "append")


def _written(rows: DataFrame, path: str, date: str, records_per_file: int, mode: str) -> None:
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    own = _uuid(F.lit("capture"), key, "digest", F.col("turn").cast("string"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    capture = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri),
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To", F.when(revisit, _uuid(F.lit("capture"), F.col("refers_to").cast("string"), "digest", F.lit("1")))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, "payload")),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.lit("request"), own)), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.lit("metadata"), own)), ("WARC-Date", F.lit(date)), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), key, F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.mode(mode).option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records_of(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record, from chunks as they come. Raises on anything that is not a record."""
    chunks, held, at = iter(chunks), bytearray(), 0

    def reach(n: int) -> bool:
        """Whether so many bytes are held from here on."""
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while reach(1):
        looked = 0
        while (end := held.find(CRLF.encode() * 2, looked)) < 0:
            looked = max(0, len(held) - 3)
            if not reach(len(held) + 1):
                raise ValueError(f"no WARC record at byte {at}")
        head = held[:end].decode().split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in head[1:])}
        length = int(headers["content-length"])
        if not reach(end + 8 + length) or held[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 8 + length]
        at += end + 8 + length


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    return records_of([data])


def inflated(content: bytes) -> Iterator[bytes]:
    """The content of a file, of one gzip member, of several, or of none, in chunks of bounded size."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            out = d.decompress(content, INFLATE_BYTES)
            content = d.unconsumed_tail
            yield out
            if not out and not content and not d.eof:
                raise ValueError("an archive is cut short")
        content = d.unused_data


RECORDS = "record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, n_bytes bigint, payload_sha256 string, fields map<string,string>"
_NAMES = ("record_id", "type", "uri", "concurrent_to", "refers_to", "digest", "n_bytes", "payload_sha256", "fields")


def read(spark: SparkSession, path: str, batch_rows: int = 5_000) -> DataFrame:
    """A row for each record of the archives in path. Payloads are measured and digested here; they go no further.

    An archive without records gives no rows; one that is cut short, or holds anything else, raises.
    """
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for h, block in records_of(inflated(content.as_py())):
                    n, sha, fields = None, None, []
                    if h["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n, sha = len(payload), hashlib.sha256(payload).hexdigest()
                    elif h["warc-type"] == "metadata":
                        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode().split(CRLF) if ":" in line]
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-payload-digest"), n, sha, fields))
                    if len(rows) == batch_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(_NAMES))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(_NAMES))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(work), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture, request, metadata, joined through concurrent-to identifiers.

    A capture without request or metadata has null there. Of several of one kind the one of the smallest record_id is
    taken; a record that names no capture, or one that is not there, is in no transaction. Repeated captures are one.
    """
    capture = records.filter(F.col("type").isin("response", "revisit")).groupBy(F.col("record_id").alias("capture_id")).agg(F.min(F.struct("type", "uri", "refers_to", "digest", "n_bytes", "payload_sha256")).alias("capture"))
    of = records.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "uri"))).alias("request"),
        F.min_by(F.when(F.col("type") == "metadata", F.struct("record_id", "fields")), F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"),
    )
    return capture.join(of, "capture_id", "left")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture; what a revisit lacks is its response's.

    Archives are read once. Captures of null pages have a null page_id; no archives or records give no rows; of very many
    revisits of one response only keys meet.
    """
    rows = assemble(written(read(spark, path)))
    page = F.col("metadata.fields")["page-id"]
    flat = written(rows.select("capture_id", F.when(page != "null", page).cast("bigint").alias("page_id"), "capture.*"))
    full = flat.filter(F.col("type") == "response").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("n_bytes").alias("_bytes"), F.col("payload_sha256").alias("_sha"))
    both = dealt_join(flat, full, ["refers_to"], flat.count())
    return both.select("page_id", F.coalesce("n_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_sha256", "_sha").alias("payload_digest"), F.col("type").alias("record_type"), F.col("_page").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 AND page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY html) END AS first,
             row_number() OVER (PARTITION BY page_id, html ORDER BY url) AS turn FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first <> page_id OR (first IS NOT NULL AND turn > 1) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id OR (first IS NOT NULL AND turn > 1) THEN first END AS refers_to
FROM f
"""
