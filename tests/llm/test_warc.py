import base64
import hashlib
import struct

import zstandard

from cellgauge.llm.catalog import queries
from cellgauge.llm.warc import SKIPPABLE, read_archives, write_archives
from tests.conftest import SF
from tests.llm.conftest import prose

PAGES = "page_id long, url string, html string, digest string, size string, kind string"


def expected(pages, min_bytes=0):
    last = {}
    for page, html in pages:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        again = len(data) >= min_bytes and (-1 if page is None else page) != last[html or ""]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[html or ""] if again else None))
    return sorted(out, key=str)


def told(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert told(queries()["op5_warc"](spark, SF).collect()) == expected(pages)


def test_round_trip_and_layout(spark, tmp_path):
    pages = [(i, f"http://h{i % 7}.example.org/{i}", f"<html>{prose(i % 300, 80)}</html>") for i in range(400)]
    frame = spark.createDataFrame([(*p, "d", "s", "k") for p in pages], PAGES)
    manifest = write_archives(frame, f"file://{tmp_path}/warc", min_bytes=10)
    back = read_archives(manifest).collect()
    assert told(back) == expected([(i, h) for i, _, h in pages], 10)
    assert {r.page_id: r.payload.decode() for r in back if r.record_type == "response"} == {i: h for i, _, h in pages if i >= 100}
    assert {r.page_id: r.url for r in back} == {i: u for i, u, _ in pages}
    records = 0
    for path in (tmp_path / "warc").iterdir():  # a plain reader with the embedded dictionary
        data = path.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == SKIPPABLE
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8: 8 + size]))
        rest = data[8 + size:]
        while rest:
            frame = decoder.decompressobj()
            assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, records = frame.unused_data, records + 1
    assert records == 400 == sum(r.records for r in manifest.collect())


def test_min_bytes_edges_and_repeats(spark, tmp_path):
    pages = [(1, None), (2, ""), (3, "x" * 9), (4, "x" * 9), (5, "y" * 2_000_000), (6, "y" * 2_000_000), (6, "y" * 2_000_000), (None, "x" * 9), (None, None), (7, "\r\n\r\n WARC/1.1 \r\n\r\n\U0001F600")]
    frame = spark.createDataFrame([(i, "http://e/\r\nX: y", h, None, None, None) for i, h in pages], PAGES)
    for n in (0, 9, 10):
        assert told(read_archives(write_archives(frame, f"file://{tmp_path}/{n}", min_bytes=n)).collect()) == expected(pages, n)
    assert read_archives(write_archives(frame.limit(0), f"file://{tmp_path}/none")).count() == 0
