"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary, built from
the archive's own records, and goes on with one Zstandard frame per WARC
record. So a single record can be read with the dictionary and its frame
alone. Of records with equal payloads, that with the largest page id is
stored as a response and the others as revisits that refer to it.

Archives are rows (archive_id, n_records, data) of a table in the shared
folder, written by Spark's own committer; ``export`` copies them to
``.warc.zst`` files in a mounted folder.

Defined results: a null payload counts as empty; a null url as an empty
target; a null page id counts as smaller than any other; repeated rows with
the largest id of their payload are all responses; an empty table gives no
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mkpulse.llm.common import materialize

#: First four bytes of the skippable frame with the dictionary (the .warc.zst convention).
DICTIONARY_FRAME = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes after which an archive is closed; a longer record has an archive to itself.
ARCHIVE_BYTES = 8 << 20
#: Dictionary size, and bytes of the archive's records it is fitted on at most (evenly spread).
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
LEVEL = 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {''.join(url.splitlines())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'null' if original is None else original}>"]
    else:
        head.append(f"WARC-Block-Digest: sha1:{digest(block)}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A dictionary fitted on an even spread of the records; where they are too few, of their own bytes."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: 128 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    import zstandard

    d = dictionary(records)
    d.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True, write_content_size=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(d.as_bytes())), d.as_bytes(), *map(compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    held = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
    rest = memoryview(data)[8 + size :]
    while rest:
        frame = reader.decompressobj()
        got = frame.decompress(rest)
        yield got
        rest = rest[len(rest) - len(frame.unused_data) :]


def parse(rec: bytes) -> dict[str, object]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return {"version": lines[0], "headers": headers, "http": fields, "payload": payload}


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The table of archives. Payloads under ``min_bytes`` are never revisits."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"))
    again = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("original"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("sha1").alias("k"), "original", F.lit(True).alias("shared")))
    again = materialize(again, "warc-shared")
    rows = rows.join(again, F.col("sha1") == F.col("k"), "left").select(
        "id", "url", "payload", "original",
        (F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("original")) & (F.octet_length("payload") >= min_bytes)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, size, held = 0, 0, []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive_id": [f"{TaskContext.get().partitionId():06d}-{n:06d}"], "n_records": [len(held)],
                                               "data": [archive(held)]})

        for b in batches:
            for i, u, p, o, again in zip(*(c for c in b.columns)):
                p = p.as_py()
                held.append(record(i.as_py(), u.as_py(), p, o.as_py(), again.as_py()))
                size += len(p)
                if size >= archive_bytes:
                    yield close()
                    n, size, held = n + 1, 0, []
        if held:
            yield close()

    return materialize(rows.mapInArrow(run, "archive_id string, n_records long, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record of the archives, as read back and checked: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    def number(urn: str) -> int | None:
        name = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if name == "null" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        for b in batches:
            for data in b.column(0):
                out = []
                for rec in read_archive(data.as_py()):
                    r = parse(rec)
                    h, revisit = r["headers"], r["headers"]["WARC-Type"] == "revisit"
                    held = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(r["payload"]) != held:
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload does not match its digest")
                    out.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], int(r["http"]["Content-Length"]), held, h["WARC-Type"],
                                number(h["WARC-Refers-To"]) if revisit else None, None if revisit else r["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])

    return archives.select("data").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                              "refers_to long, payload binary")


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as ``folder/<archive_id>.warc.zst``; the folder is mounted on every executor.

    A file appears under its name only when it is whole, so a repeated task does no harm.
    """
    def save(rows: Iterable) -> None:
        for r in rows:
            path = os.path.join(folder, f"{r['archive_id']}.warc.zst")
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                f.write(r["data"])
            os.replace(f.name, path)

    archives.foreachPartition(save)
