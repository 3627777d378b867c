import hashlib
import io
import random
import struct

import pytest
import zstandard

from tests.llm.cases import prose
from verdant.llm import warc as W
from verdant.llm.shared import new_path

SCHEMA = "page_id long, url string, html string"


def archive(n=30):
    rng = random.Random(1)
    pages = [prose(rng, 200).encode() for _ in range(n)]
    words = W.dictionary(pages * 12, 4096)
    out = io.BytesIO()
    a = W.ArchiveWriter(out, words)
    for i, p in enumerate(pages):
        a.add(W._record("response", f"urn:page:{i}", "http://x", W.sha1_base32(p), len(p), p, None))
    return out.getvalue(), pages, words


def test_round_trip_with_the_leading_dictionary():
    data, pages, words = archive()
    assert words and struct.unpack("<I", data[:4])[0] == W.DICTIONARY_FRAME
    assert [p for _, p in W.read_archive(io.BytesIO(data))] == pages
    with pytest.raises(W.WarcError):  # frames need the dictionary
        list(W.read_archive(io.BytesIO(data[8 + struct.unpack("<I", data[4:8])[0] :])))


def test_frames_of_all_kinds_are_walked():
    texts = [b"", b"a", b"a" * 100_000, bytes(random.Random(2).randbytes(300_000))]
    for checksum in (False, True):
        for size in (False, True):
            c = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=size)
            data = b"".join(c.compress(t) + struct.pack("<II", 0x184D2A50, 3) + b"xyz" for t in texts)
            got = [f for m, f in W.frames(io.BytesIO(data)) if m == W.ZSTD_FRAME]
            assert [zstandard.ZstdDecompressor().decompress(f, max_output_size=400_000) for f in got] == texts


def test_broken_archives_are_refused():
    data, _, _ = archive(3)
    for broken in (data[:-1], data + b"xx", data + b"abcdefgh"):
        with pytest.raises(W.WarcError):
            list(W.read_archive(io.BytesIO(broken)))
    good = W._record("response", "u", "x", W.sha1_base32(b"hi"), 2, b"hi", None)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type", b"WARC-Kind"), good[:-2], good.replace(b"\r\nhi", b"\r\nho"), good.replace(b"WARC-Payload-Length: 2", b"WARC-Payload-Length: 3"), good.replace(b"Content-Length: 8", b"Content-Length: 7")):
        with pytest.raises(W.WarcError):
            list(W.read_archive(io.BytesIO(zstandard.compress(bad))))


def test_pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", rng.choice(["same", "é other", prose(rng, 40)])) for i in range(60)] + [(100, None, None), (101, "u\r\nv", ""), (5, "again", "same"), (None, "n", "same"), (102, "x", "long " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("sha1", "path", "refers_to", "_last"):
        df = df.withColumn(c, df.page_id)
    got = sorted((tuple(r) for r in W.read_archives(W.write_archives(df, new_path(spark, "w"))).collect()), key=repr)
    last = {}
    for d, _, h in rows:
        last.setdefault(h or "", []).append(d)
    want = []
    for d, _, h in rows:
        b = (h or "").encode()
        most = max((x for x in last[h or ""] if x is not None), default=None)
        want.append((d, len(b), W.base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if d == most else "revisit", None if d == most else most))
    assert got == sorted(want, key=repr)
    assert W.read_archives(W.write_archives(spark.createDataFrame([], SCHEMA), new_path(spark, "w"))).count() == 0


def test_small_payloads_do_not_revisit(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], SCHEMA)
    got = {r["page_id"]: r["record_type"] for r in W.read_archives(W.write_archives(df, new_path(spark, "w"), least_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_frames_without_a_content_size():
    record = W._record("response", "u", "x", W.sha1_base32(b"hi" * 9000), 18_000, b"hi" * 9000, None)
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    data = stream.compress(record) + stream.flush()
    assert [p for _, p in W.read_archive(io.BytesIO(data * 2))] == [b"hi" * 9000] * 2
    with pytest.raises(W.WarcError):
        list(W.read_archive(io.BytesIO(data[:-1])))
