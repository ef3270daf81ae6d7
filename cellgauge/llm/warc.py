"""WARC archives compressed record by record with a dictionary of their own.

Every archive begins with a skippable frame that holds a Zstandard dictionary,
built from the first records of the archive; each record then is a frame of
its own, so that a reader can start at any record once it has the dictionary.

Tasks write one archive at a time into shared storage, under a name no other
attempt uses, and return its name. Only names that a finished task returned
are read back, so a lost executor or a repeated attempt leaves at most a file
that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.session import scratch_path, stage

SKIPPABLE = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def _record(kind: str, page: int | None, url: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    # page numbers and full lengths are extension fields; the format lets readers skip those they don't know
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    lines += [] if page is None else [f"X-Page-ID: {page}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": kind,
            "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def _write(folder: str, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = pafs.FileSystem.from_uri(folder)
        prefix = folder[: len(folder) - len(root)]
        rows = (row for batch in batches for part in range(0, len(batch), 64) for row in batch.slice(part, 64).to_pylist())
        row = next(rows, None)
        while row is not None:
            sample, held = [], 0
            while row is not None and held < SAMPLE_BYTES:  # these records, of bounded size, are written first
                payload = (row["html"] or "").encode() if row["kind"] == "response" else b""
                sample.append(_record(row["kind"], row["page_id"], _clean(row["url"]), row["digest"], row["size"], row["refers_to"], payload))
                held += len(sample[-1])
                row = next(rows, None)
            try:
                # a dictionary pays off where it is small beside what it is built from
                dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1 << 10, held // 16)), [s[:1 << 16] for s in sample])
            except zstandard.ZstdError:  # too few records: the archive goes without
                dictionary = None
            coder = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            records = 0
            files.create_dir(root, recursive=True)
            with files.open_output_stream(path, compression=None) as out:
                if dictionary is not None:
                    data = dictionary.as_bytes()
                    out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
                for record in sample:
                    out.write(coder.compress(record))
                    records += 1
                while row is not None and out.tell() < archive_bytes:
                    payload = (row["html"] or "").encode() if row["kind"] == "response" else b""
                    out.write(coder.compress(_record(row["kind"], row["page_id"], _clean(row["url"]), row["digest"], row["size"], row["refers_to"], payload)))
                    records += 1
                    row = next(rows, None)
                size = out.tell()
            yield pa.RecordBatch.from_pydict({"path": [prefix + path], "records": [records], "bytes": [size]})

    return run


def _clean(url: str | None) -> str:
    """Line ends can't stand in a header."""
    return " ".join((url or "").splitlines())


def _frames(stream) -> Iterator[bytes]:
    """The records of an archive, one decompressed frame at a time."""
    import zstandard

    head = stream.read(8)
    data = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        data, head = stream.read(struct.unpack("<I", head[4:])[0]), b""
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    waiting = head
    frame, parts = decoder.decompressobj(), []
    while True:
        waiting = waiting or stream.read(READ_BYTES)
        if not waiting:
            return
        parts.append(frame.decompress(waiting))
        waiting = b""
        if frame.eof:
            yield b"".join(parts)
            waiting = frame.unused_data
            frame, parts = decoder.decompressobj(), []


def _read(with_payload: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema([(n, t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as stream:
                    found, held = [], 0
                    for record in _frames(stream):
                        row = _parse(record)
                        held += len(record) if with_payload else 256
                        if not with_payload:
                            row["payload"] = None
                        found.append(row)
                        if held > 8 * READ_BYTES:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema)

    return run


def record_roles(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, size, digest, kind and refers_to for each distinct (key, payload) of ``pages``.

    Payload lengths, digests and keys alone are compared: no page text is shuffled here.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    seen = stage(pages.select(F.col(key).cast("long").alias("_key"), F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("_code")).distinct(), "warc-digests")
    latest = seen.filter(F.col("size") >= min_bytes).groupBy("_code").agg(F.max("_key").alias("_latest"))
    joined = seen.join(latest, "_code", "left")
    again = (F.col("size") >= min_bytes) & ~F.col("_key").eqNullSafe(F.col("_latest"))
    # base32 of the 160 bits: four times 40 bits, five at a time
    alphabet, code = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.col("_code")
    groups = [F.conv(F.substring(code, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    letters = [F.substring(alphabet, F.shiftright(g, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for g in groups for j in range(8)]
    return joined.select("_key", "_code", "size", F.concat(*letters).alias("digest"), F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("_latest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, archive_bytes: int = ARCHIVE_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as compressed archives into ``folder`` and return the manifest: path, records and bytes of each.

    ``folder`` is a URI that all executors reach. Of the pages with equal
    payloads of at least ``min_bytes`` bytes the one with the largest key is a
    response and the others are revisits that name it; rows repeated as a
    whole are responses (or revisits) each. Null html is an empty payload,
    null urls are empty. A null key counts as smaller than any.
    """
    roles = stage(record_roles(pages, min_bytes, key, html), "warc-roles")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(F.coalesce(F.col(html), F.lit(""))).alias("_code"))
    same = rows["page_id"].eqNullSafe(roles["_key"]) & (rows["_code"] == roles["_code"])
    told = rows.join(roles.hint("shuffle_hash"), same).select("page_id", "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "size", "digest", "kind", "refers_to")
    return stage(told.mapInArrow(_write(folder, level, archive_bytes), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that ``manifest`` lists: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Digests of response payloads are checked. Revisits have no payload of
    their own. ``payloads=False`` leaves payloads out. Archives are dealt over
    the tasks one by one.
    """
    spark = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(_read(payloads), RECORD)


def archive_folder(pages: DataFrame) -> str:
    return scratch_path(pages.sparkSession, "warc")
