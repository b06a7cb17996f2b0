"""Archives stay of a bounded size, whatever sizes of payloads follow each other."""

import gzip

from shelfmark.llm import warc
from shelfmark.llm.common import scratch_dir


def test_large_payloads_have_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_PAYLOAD", 1_000)
    monkeypatch.setattr(warc, "MOST_BYTES", 50_000)
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    rows = [(i, f"http://x/{i}", "s" * (i % 50)) for i in range(300)] + [(1000 + i, f"http://x/l{i}", chr(97 + i) * 40_000) for i in range(7)]
    place = scratch_dir(spark)
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), place)
    names = [r.path for r in spark.read.format("binaryFile").load(place).select("path").collect()]
    sizes = [len(gzip.decompress(open(n.removeprefix("file:"), "rb").read())) for n in names if n.endswith(".gz")]
    assert max(sizes) < 60_000 and len(sizes) >= 7 + 2
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.digests(spark, place).collect()}
    assert got == {i: (len(h), "response") for i, _, h in rows}
