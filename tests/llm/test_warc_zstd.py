import base64
import hashlib
import os

import pytest
from edge import clashing

from mkpulse.llm import warc_zstd as W

SCHEMA = "page_id long, url string, html string"
PAGES = [(1, "http://a.com/", "<p>one</p>"), (2, "http://b.com/", "<p>one</p>"), (5, None, "<p>one</p>"), (3, "http://c.com/\r\nX: y", None), (4, "u", ""),
         (6, "é", "é\r\n\r\nWARC/1.1\r\n" * 3), (7, "big", "long text " * 60_000), (None, "n", "<p>one</p>"), (None, "m", "only null"), (8, "r", "twice"), (8, "r", "twice")]


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(same, default=None)
        revisit = len(b) >= least and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, size", [(0, 8 << 20), (0, 100), (6, 8 << 20)])
def test_round_trip(spark, least, size):
    pages = clashing(spark.createDataFrame(PAGES, SCHEMA))
    archives = W.write_archives(pages, min_bytes=least, archive_bytes=size).cache()
    back = W.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == brute(PAGES, least)
    for r in back:
        if r.record_type == "response":
            assert bytes(r.payload).decode() in {h or "" for i, _, h in PAGES if i == r.page_id}
    assert archives.agg({"n_records": "sum"}).first()[0] == len(PAGES)


def test_dictionary_frame_and_single_records(spark):
    import struct

    import zstandard

    records = [W.record(i, f"http://x/{i}", f"<html><body>common words in all pages {i * i}</body></html>".encode() * 3, None, False) for i in range(300)]
    data = W.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and list(W.read_archive(data)) == records
    # any frame can be read alone with the dictionary
    d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    rest, frames = data[8 + size :], []
    while rest:
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        assert o.decompress(rest) == records[len(frames)]
        frames.append(len(rest) - len(o.unused_data))
        rest = o.unused_data
    plain = sum(len(zstandard.ZstdCompressor(level=W.LEVEL).compress(r)) for r in records)
    assert len(frames) == 300 and sum(frames) < 0.7 * plain


def test_records_are_warc(spark):
    r = W.parse(W.record(7, "http://x/", b"body", 9, True))
    assert r["version"] == "WARC/1.1" and r["headers"]["WARC-Refers-To"] == "<urn:page:9>" and r["payload"] == b"" and r["http"]["Content-Length"] == "4"


def test_damaged_payload_is_noticed(spark):
    bad = W.record(1, "u", b"payload", None, False).replace(b"payload\r\n", b"Payload\r\n")
    frame = spark.createDataFrame([("a", 1, bytearray(W.archive([bad])))], "archive_id string, n_records long, data binary")
    with pytest.raises(Exception, match="digest"):
        W.read_archives(frame).collect()


def test_export(spark, scratch):
    archives = W.write_archives(spark.createDataFrame(PAGES, SCHEMA), archive_bytes=50)
    W.export(archives, scratch)
    names = os.listdir(scratch)
    assert len(names) == archives.count() and all(n.endswith(".warc.zst") for n in names)
    assert sum(len(list(W.read_archive(open(os.path.join(scratch, n), "rb").read()))) for n in names) == len(PAGES)


def test_empty_table(spark):
    assert W.read_archives(W.write_archives(spark.createDataFrame(PAGES, SCHEMA).limit(0))).count() == 0
